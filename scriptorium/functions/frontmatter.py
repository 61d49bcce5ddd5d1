"""Title, authors, abstract, language, year and journal of a paper's plain text, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

# Letters that only Vietnamese text has in number.
VIETNAMESE = "àáạảãăắặẳẵâấậầẩẫđèéẹẻẽêếệềểễìíịỉĩòóọỏõôốộồổỗơớợờởỡùúụủũưứựừửữỳýỵỷỹÀÁẠẢÃĂẮẶẲẴÂẤẬẦẨẪĐÈÉẸẺẼÊẾỆỀỂỄÌÍỊỈĨÒÓỌỎÕÔỐỘỒỔỖƠỚỢỜỞỠÙÚỤỦŨƯỨỰỪỬỮỲÝỴỶỸ"
# Dates of a paper, the first that is found.
DATES = [r"Ngày duyệt đăng[^\n]{0,40}(20[12]\d)", r"Tháng\s*\d{1,2}/(20[12]\d)", r"Ngày PB[^\n]{0,40}(20[12]\d)", r"Ngày nhận[^\n]{0,40}(20[12]\d)", r"\b(20[12]\d)\b"]
# How lines begin that are page furniture, and lines that end a title.
SKIPPED = r"(?iu)^(\d{1,4}\s|trang\s|page\s|vol\.?\s|số\s|trường\s|tạp chí\s|journal\s)"
STOPS = r"(?iu)^(Tóm tắt|Abstract|Từ khóa|Keywords|\d+\.\s|Email|Ngày\s|Khoa\s|Faculty\s)"
# How lines begin that name a place of work, not a person.
PLACES = r"(?iu)^(Khoa|Trường|Email|Ngày|Faculty|Department|University|@)"
# Words that begin a journal's name.
JOURNALS = r"(?iu)(?:TẠP CHÍ|JOURNAL OF|PROCEEDINGS OF|CONFERENCE ON)\s+([^\n]{5,80})"


def language(text: Column) -> Column:
    head = F.substring(text, 1, 500)
    return F.when(F.length(head) - F.length(F.translate(head, VIETNAMESE, "")) > 5, "vi").otherwise("en")


def year(text: Column) -> Column:
    head = F.substring(text, 1, 3000)
    return F.coalesce(*[F.regexp_extract(head, p, 1).try_cast("int") for p in DATES])


def journal(text: Column) -> Column:
    found = F.rtrim(strip(F.regexp_extract(F.substring(text, 1, 1000), JOURNALS, 1)), F.lit(".,"))
    return F.when(found != "", found)


def title(text: Column) -> Column:
    """The first run of lines in capitals among the first thirty, joined."""
    lines = F.slice(F.filter(F.transform(F.split(text, "\n"), strip), lambda x: x != ""), 1, 30)
    start = F.struct(F.array().cast("array<string>").alias("held"), F.lit(False).alias("done"))

    def add(acc: Column, line: Column) -> Column:
        passed = (F.length(line) < 8) | line.rlike(SKIPPED)
        stop = line.rlike(STOPS) | F.contains(line, F.lit("@"))
        capitals = (F.length(line) - F.length(F.regexp_replace(line, r"\p{Lu}", ""))) / F.greatest(F.length(line), F.lit(1)) > 0.35
        taken = capitals & (F.length(line) > 8) & (F.length(line) < 250) & ~stop
        begun = F.size(acc["held"]) > 0
        held = F.when(~acc["done"] & ~passed & taken, F.array_append(acc["held"], line)).otherwise(acc["held"])
        return F.struct(held.alias("held"), (acc["done"] | (~passed & ~taken & begun)).alias("done"))

    return F.array_join(F.aggregate(lines, start, add, lambda acc: acc["held"]), " ")


def authors(text: Column, found_title: Column) -> Column:
    """Names of two to six words between the title and the abstract."""
    at = F.when(found_title != "", F.instr(text, found_title)).otherwise(0)
    begin = F.when(at > 0, at + F.length(found_title)).otherwise(1)
    before = F.regexp_extract(text, r"(?isu)^(.*?)(?:Tóm tắt|Abstract)\s*[:.]?", 1)
    end = F.when(text.rlike(r"(?iu)(?:Tóm tắt|Abstract)"), F.length(before)).otherwise(F.least(F.length(text), F.lit(1500)))
    region = F.substring(text, begin, F.greatest(end - begin + 1, F.lit(0)))
    lines = F.filter(F.transform(F.split(region, "\n"), strip), lambda x: F.length(x).between(4, 150) & ~x.rlike(PLACES) & ~x.rlike("@|http"))
    names = F.flatten(F.transform(lines, lambda x: F.transform(F.split(x, r"[,;]|\s+và\s+|\s+and\s+"), strip)))
    return F.filter(names, lambda n: F.size(F.split(n, r"\s+")).between(2, 6) & ~n.rlike(r"\d") & (F.length(n) < 60) & n.rlike("[A-ZÀ-ỸĐ]"))


def abstract(text: Column) -> Column:
    """The Vietnamese abstract of more than 50 characters, else the English one, else ''."""
    ways = [r"(?isu)Tóm tắt\s*[:.]?\s*(.*?)(?=\n\s*(?:Từ khóa|Keywords|Abstract|\d+\.\s))", r"(?isu)Abstract\s*[:.]?\s*(.*?)(?=\n\s*(?:Keywords|Từ khóa|\d+\.\s|Introduction))"]
    found = [strip(F.regexp_extract(text, p, 1)) for p in ways]
    return reduce(lambda rest, x: F.when(F.length(x) > 50, strip(F.regexp_replace(x, r"\s*\n\s*", " "))).otherwise(rest), reversed(found), F.lit(""))

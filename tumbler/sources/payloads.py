"""Reported draws from JSON, HTML, CSV and text payloads, as DataFrame expressions.

Each function takes a table with a `content` string (one payload per row, or one line per row for text) and
returns rows with d (date), numbers and what else the payload holds. What doesn't parse gives no row.
"""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def numbers_in(text: Column) -> Column:
    """All whole numbers of a text, in order."""
    return F.regexp_extract_all(text, F.lit(r"(\d+)"), 1).cast("array<int>")


def money(text: Column) -> Column:
    """'$389.00M', '1.2 Billion', '5,000' as DECIMAL(18,2)."""
    digits = F.regexp_replace(F.regexp_extract(text, r"([0-9][0-9,]*\.?[0-9]*)", 1), ",", "")
    scale = F.when(text.rlike(r"(?i)[0-9]\s*b"), 1_000_000_000).when(text.rlike(r"(?i)[0-9]\s*m"), 1_000_000).otherwise(1)
    return (F.nullif(digits, F.lit("")).try_cast("decimal(18,4)") * scale).cast("decimal(18,2)")


def json_draws(payloads: DataFrame, date_field: str, numbers_field: str, special_field: str | None = None, second_field: str | None = None) -> DataFrame:
    """A JSON array of objects whose numbers are blank-joined. Without a special field the last number is special.
    second_field holds another stream's numbers. A payload that isn't an array gives no rows."""
    fields = [date_field, numbers_field, *[f for f in (special_field, second_field) if f]]
    schema = "array<struct<" + ",".join(f"{f}:string" for f in fields) + ">>"
    rows = payloads.where(F.trim("content").startswith("[")).select("*", F.explode(F.from_json("content", schema)).alias("r"))
    day = F.to_date(F.substring(f"r.{date_field}", 1, 10))

    def stream(name: str, field: str) -> DataFrame:
        n = numbers_in(F.col(f"r.{field}"))
        special = F.col(f"r.{special_field}").try_cast("int") if special_field and name == "main" else F.element_at(n, -1)
        main = n if special_field and name == "main" else F.slice(n, 1, F.greatest(F.size(n) - 1, F.lit(0)))
        out = rows.where(F.col(f"r.{field}").isNotNull() & (F.size(n) > 1))
        return out.select(day.alias("d"), F.lit(name).alias("stream"), main.alias("numbers"), special.alias("special"))

    main = stream("main", numbers_field)
    return main.unionByName(stream("second", second_field)) if second_field else main


def nested_json_draws(payloads: DataFrame, outer: str, array_field: str, date_field: str, number_fields: list[str], special_field: str, multiplier_field: str) -> DataFrame:
    """A JSON object whose field `outer` holds JSON text with an array of draws. A multiplier below 1 is missing."""
    item = ",".join(f"{f}:string" for f in [date_field, *number_fields, special_field, multiplier_field])
    inner = F.from_json(F.get_json_object("content", f"$.{outer}"), f"struct<{array_field}:array<struct<{item}>>>")
    rows = payloads.select(F.explode(inner[array_field]).alias("r"))
    multiplier = F.col(f"r.{multiplier_field}").try_cast("int")
    return rows.select(F.to_date(F.substring(f"r.{date_field}", 1, 10)).alias("d"), F.array(*[F.col(f"r.{f}").try_cast("int") for f in number_fields]).alias("numbers"), F.col(f"r.{special_field}").try_cast("int").alias("special"), F.when(multiplier > 0, multiplier).alias("multiplier"))


def html_draws(payloads: DataFrame, row: str, date: str, date_format: str, number: str, count: int, special: str | None = None, second: str | None = None) -> DataFrame:
    """Blocks that match `row`; in each, the first `date` and all `number` groups. A block with another count is dropped.

    With `second`, what follows this text in a block is a draw of its own: stream is main or second, each with its numbers
    and special label.
    """
    blocks = payloads.select(F.explode(F.regexp_extract_all("content", F.lit(row), 0)).alias("b"))
    blocks = blocks.withColumn("d", F.try_to_date(F.regexp_extract("b", date, 1), date_format))
    if second:
        at = F.instr("b", second)
        parts = F.array(F.struct(F.lit("main").alias("stream"), F.when(at > 0, F.substring("b", F.lit(1), at - 1)).otherwise(F.col("b")).alias("b")), F.struct(F.lit("second").alias("stream"), F.when(at > 0, F.substring("b", at, F.length("b"))).alias("b")))
        blocks = blocks.select("d", F.inline(parts)).where("b IS NOT NULL")
    n = F.regexp_extract_all("b", F.lit(number), 1).cast("array<int>")
    s = F.nullif(F.regexp_extract("b", special, 1), F.lit("")).try_cast("int") if special else F.lit(None).cast("int")
    out = blocks.select("d", *["stream"] * bool(second), n.alias("numbers"), s.alias("special"))
    return out.where(F.col("d").isNotNull() & (F.size("numbers") == count))


def positional_csv_draws(lines: DataFrame, k: int) -> DataFrame:
    """Lines game,MM,DD,YYYY,n1..nk,special,multiplier; lines with anything unreadable are skipped."""
    c = F.transform(F.split("content", ","), lambda x: F.trim(x))
    at = lambda i: F.get(c, F.lit(i))
    numbers = F.array(*[at(4 + i).try_cast("int") for i in range(k)])
    day = F.try_to_date(F.concat_ws("-", at(3), F.lpad(at(1), 2, "0"), F.lpad(at(2), 2, "0")), "yyyy-MM-dd")
    out = lines.select(at(0).alias("game"), day.alias("d"), numbers.alias("numbers"), at(4 + k).try_cast("int").alias("special"), at(5 + k).try_cast("int").alias("multiplier"))
    return out.where(F.col("d").isNotNull() & ~F.exists("numbers", F.isnull))


def dated_csv_draws(lines: DataFrame, k: int) -> DataFrame:
    """Lines date,n1..nk,special,'3x','$389.00M'."""
    c = F.transform(F.split("content", ","), lambda x: F.trim(x))
    at = lambda i: F.get(c, F.lit(i))
    numbers = F.array(*[at(1 + i).try_cast("int") for i in range(k)])
    out = lines.select(F.coalesce(F.try_to_date(at(0), "yyyy-MM-dd"), F.try_to_date(at(0), "M/d/yyyy")).alias("d"), numbers.alias("numbers"), at(1 + k).try_cast("int").alias("special"), F.regexp_extract(at(2 + k), r"^[xX]?(\d+)[xX]?$", 1).try_cast("int").alias("multiplier"), money(at(3 + k)).alias("jackpot"))
    return out.where(F.col("d").isNotNull() & ~F.exists("numbers", F.isnull))


def short_year(two: Column, pivot: int = 50) -> Column:
    """00..pivot-1 are of this century, the others of the last."""
    return F.when(two < pivot, 2000 + two).otherwise(1900 + two)


def tagged_lines(lines: DataFrame, forms: list[tuple[str, str]]) -> DataFrame:
    """Lines of a tagged history: M/D/YY, numbers joined by '-', and a tail.

    forms: (name, regular expression of the tail), tried in order. Returns d, numbers, form and tail; other lines
    give nothing. Numbers keep the line's order.
    """
    head = r"^\s*(\d{1,2})/(\d{1,2})/(\d{2})\s+((?:\d{1,2}\s*-\s*)+\d{1,2})\s*(.*)$"
    part = lambda i: F.regexp_extract("content", head, i)
    rows = lines.where(F.col("content").rlike(head)).select(part(1).alias("m"), part(2).alias("dd"), part(3).cast("int").alias("yy"), part(4).alias("n"), F.upper(F.trim(part(5))).alias("tail"))
    form = F.coalesce(*[F.when(F.col("tail").rlike(rx), F.lit(name)) for name, rx in forms])
    day = F.try_to_date(F.concat_ws("-", short_year(F.col("yy")).cast("string"), F.lpad("m", 2, "0"), F.lpad("dd", 2, "0")), "yyyy-MM-dd")
    return rows.select(day.alias("d"), numbers_in(F.col("n")).alias("numbers"), form.alias("form"), "tail").where("d IS NOT NULL AND form IS NOT NULL")


def history_lines(lines: DataFrame) -> DataFrame:
    """Lines (game, content) of a tagged history: M/D/YY, blank-separated numbers, and words that say the rest.

    The words before the first that is no number are the draw. What follows is read from left to right: in lotto nothing, or
    the tag LOTTO (and DP) and perhaps machine / balls, or X with a multiplier and machine / balls; in powerball PB with the special,
    perhaps a multiplier, and the tag POWERBALL (and DP); in mega MB with the special and perhaps a multiplier. DP marks the second stream.
    Returns game, d, stream, numbers (in the line's order), special, multiplier, machine, balls. What is in no such form, or
    has no numbers or date, gives nothing.
    """
    words = F.split(F.trim(F.regexp_replace(F.regexp_replace(F.upper("content"), "/", " / "), r"\s+", " ")), " ")
    # A date is five words: M / D / YY.
    # Columns that later ones use many times are bound by explode, which filters and projections are not moved through; else each
    # use would hold the whole chain before it.
    once = lambda x, name: F.explode(F.array(x)).alias(name)
    rows = lines.select("game", once(words, "w")).where("size(w) > 5 AND w[1] = '/' AND w[3] = '/'")
    number = lambda w: w.rlike("^[0-9]{1,2}$")
    rows = rows.where(number(F.col("w")[0]) & number(F.col("w")[2]) & F.col("w")[4].rlike("^[0-9]{2}$"))
    rest = F.slice("w", 6, F.greatest(F.size("w") - 5, F.lit(0)))
    rows = rows.select("game", "w", once(rest, "rest"))
    first_other = F.array_position(F.transform("rest", lambda w: w.rlike("^[0-9]+$")), False)
    n = F.when(first_other > 0, first_other - 1).otherwise(F.size("rest")).cast("int")
    rows = rows.select("game", "w", "rest", once(n, "n"))
    rows = rows.select("game", "w", F.slice("rest", F.lit(1), F.col("n")).alias("numbers"), once(F.slice("rest", F.col("n") + 1, F.size("rest") - F.col("n")), "tail"))
    at = lambda i: F.get("tail", i if isinstance(i, Column) else F.lit(i))
    times = lambda w: F.when(w.rlike("^X[0-9]+$"), F.substring(w, 2, 9))
    tag = at(0)
    bonus = tag.isin("PB", "MB")
    special = F.when(bonus & at(1).rlike("^[0-9]+$"), at(1))
    multiplier = F.when(bonus, times(at(2))).otherwise(times(tag))
    rows, multiplier = rows.select("*", once(multiplier, "multiplier")), F.col("multiplier")
    # The place of the tag that closes a line, and whether DP follows it.
    closing = F.when(tag == "LOTTO", F.lit(0)).when(tag == "PB", F.when(multiplier.isNotNull(), 3).otherwise(2))
    second = F.coalesce(at(closing + 1) == "DP", F.lit(False))
    begin = F.when(tag == "LOTTO", F.when(second, 2).otherwise(1)).when(~bonus & multiplier.isNotNull(), 1)
    rows, second, begin = rows.select("*", once(second, "second")).select("*", once(begin, "begin")), F.col("second"), F.col("begin")
    slash = F.coalesce(at(begin + 1) == "/", F.lit(False))
    machine = F.when(at(begin) != "/", at(begin))
    balls = F.when(slash, at(begin + 2))
    ends = F.size("tail") == begin + F.when(slash, 3).when(machine.isNotNull(), 1).otherwise(0)
    fits = (
        F.when(F.col("game") == "lotto", (F.size("tail") == 0) | F.when(tag == "LOTTO", ends).otherwise(~bonus & multiplier.isNotNull() & balls.isNotNull() & ends))
        .when(F.col("game") == "powerball", (tag == "PB") & special.isNotNull() & (at(closing) == "POWERBALL"))
        .when(F.col("game") == "mega", (tag == "MB") & special.isNotNull())
    )
    day = F.try_to_date(F.concat_ws("-", short_year(F.col("w")[4].cast("int")).cast("string"), F.lpad(F.col("w")[0], 2, "0"), F.lpad(F.col("w")[2], 2, "0")), "yyyy-MM-dd")
    out = rows.where(F.coalesce(fits, F.lit(False))).select(
        "game", day.alias("d"), F.when(second, "second").otherwise("main").alias("stream"), F.transform("numbers", lambda w: w.cast("int")).alias("numbers"),
        special.try_cast("int").alias("special"), multiplier.try_cast("int").alias("multiplier"), machine.alias("machine"), balls.alias("balls"),
    )
    return out.where(F.col("d").isNotNull() & (F.size("numbers") > 0))


SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def column_number(reference: str) -> int:
    """0 for A1, 27 for AB7."""
    n = 0
    for letter in re.match("[A-Z]*", reference)[0]:
        n = 26 * n + ord(letter) - 64
    return n - 1


def workbook_rows(raw: bytes, width: int):
    """The first sheet's rows as lists of `width` texts, read as a stream; a cell's place is that of its reference, and cells
    that are left out are empty."""
    text = lambda x: "".join(t.text or "" for t in x.iter(f"{SHEET}t"))
    with zipfile.ZipFile(io.BytesIO(raw)) as book:
        names = set(book.namelist())
        strings = []
        if "xl/sharedStrings.xml" in names:
            with book.open("xl/sharedStrings.xml") as f:
                strings = [text(x) for _, x in ElementTree.iterparse(f) if x.tag == f"{SHEET}si"]
        sheets = {int(n[19:-4]): n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)}
        with book.open(sheets[min(sheets)]) as f:
            for _, row in ElementTree.iterparse(f):
                if row.tag != f"{SHEET}row":
                    continue
                cells = [""] * width
                for i, cell in enumerate(row.iter(f"{SHEET}c")):
                    at, value = (column_number(cell.get("r")) if cell.get("r") else i), cell.findtext(f"{SHEET}v", "")
                    if at < width:
                        kind = cell.get("t")
                        cells[at] = strings[int(value)] if kind == "s" else text(cell) if kind == "inlineStr" else value
                row.clear()
                yield cells


def xlsx_draws(files: DataFrame) -> DataFrame:
    """binaryFile rows of workbooks: dd-mm-yyyy date, as-drawn '--'-joined, sorted '--'-joined, special, multiplier, jackpot text.

    A sequence counts as physical order only if it differs from the sorted one, else its order is unknown. A multiplier
    of 0 is missing, and a jackpot without a scale is in millions. Headers and rows without numbers are skipped.
    """

    # A workbook at a time: an Arrow batch would be 10,000 of them.
    read = F.udf(lambda raw: [tuple(r) for r in workbook_rows(bytes(raw), 6)], "array<struct<day string, drawn string, sorted string, special string, multiplier string, jackpot string>>", useArrow=False)
    rows = files.select("path", F.inline(read("content")))
    n, ordered = numbers_in(F.col("drawn")), numbers_in(F.col("sorted"))
    day = F.try_to_date(F.regexp_extract("day", r"^(\d{2}-\d{2}-\d{4})", 1), "dd-MM-yyyy")
    scale = F.when(F.col("jackpot").rlike("(?i)billion"), 1_000_000_000).otherwise(1_000_000)
    jackpot = (F.nullif(F.regexp_extract("jackpot", r"\$([0-9.]+)", 1), F.lit("")).try_cast("decimal(18,4)") * scale).cast("decimal(18,2)")
    multiplier = F.col("multiplier").try_cast("double").cast("int")
    out = rows.select("path", day.alias("d"), n.alias("numbers"), F.when(n != ordered, "physical").otherwise("unknown").alias("claim"), F.col("special").try_cast("int").alias("special"), F.when(multiplier != 0, multiplier).alias("multiplier"), jackpot.alias("jackpot"), F.size(ordered).alias("k"))
    return out.where(F.col("d").isNotNull() & (F.size("numbers") > 0) & (F.col("k") > 0)).drop("k")


def dispatch(payloads: DataFrame, parsers: dict) -> DataFrame:
    """(source, d, numbers, special) of payloads (source, content, sha256), each through its source's parser. Running it raises on
    a content whose hash is not the one on record; sources without a parser give nothing."""
    same = F.sha2(F.col("content").cast("binary"), 256) == F.col("sha256")
    wrong = F.raise_error(F.concat(F.lit("content differs from its hash: "), F.coalesce("sha256", F.lit("none")))).cast("boolean")
    good = payloads.where(F.when(same, F.lit(True)).otherwise(wrong))
    out = None
    for name, parser in parsers.items():
        part = parser(good.where(F.col("source") == name)).select(F.lit(name).alias("source"), "d", "numbers", "special")
        out = part if out is None else out.unionByName(part)
    return out


#: name -> parser; a reader picks by the name registered for a source.
PARSERS = {"json": json_draws, "nested_json": nested_json_draws, "html": html_draws, "positional_csv": positional_csv_draws, "dated_csv": dated_csv_draws, "tagged": tagged_lines, "history_lines": history_lines, "xlsx": xlsx_draws}

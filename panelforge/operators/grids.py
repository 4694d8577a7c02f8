"""Printed threshold tables to rows, from positioned words or glyphs: one plan for all documents of a layout.

Input is (doc, page, text, x0, x1, top), and ``font`` for glyphs; texts are normalised before. A page's words are dealt by
(doc, page), and lines are arrays within a row, so columns are found by expressions on the row. What a document carries from
page to page (column positions, a school, a level) is a window over the document's lines, of which a document has a few
thousand at most; documents are read side by side.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions.cells import classified, classified_symbols, level_of, program_name
from panelforge.functions.text import numbered_school, school_identity, squash, without_digits
from panelforge.operators.layout import before_gap, islands
from panelforge.operators.merge import prefix_renamed
from panelforge.operators.rules import code_titles
from panelforge.plans.stored import stored

PAGE = ["doc", "page"]
TOLERANCE = 2.5
TAIL = 4  # words that a cell at the end of a line has at most


def _joined(words: Column) -> Column:
    return squash(F.array_join(words["text"], " "))


def _once(value: Column, made) -> Column:
    """``made`` of a value that it names several times and that is to be computed once."""
    return F.get(F.transform(F.array(value), made), F.lit(0))


def lines_of(words: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """(doc, page, line, words, text): the words of each line from left to right; a line is a chain of near tops."""
    lined = islands(words, PAGE, "top", tolerance, "line")
    found = lined.groupBy(*PAGE, "line").agg(F.sort_array(F.collect_list(F.struct("x0", "x1", "text"))).alias("words"))
    return found.withColumn("text", _joined(F.col("words")))


def _carried(geometry: DataFrame) -> DataFrame:
    """(doc, page, head) of every page: its own header or the last one before it; pages before the first header are left out."""
    upto = Window.partitionBy("doc").orderBy("page").rowsBetween(Window.unboundedPreceding, 0)
    return geometry.withColumn("head", F.last("head", ignorenulls=True).over(upto)).where("head is not null")


def _last_x(test: Column) -> Column:
    """Where the last word of a page that meets ``test`` begins."""
    return F.max_by(F.when(test, F.col("x0")), F.when(test, F.struct("top", "x0")))


def _between(words: Column, low: Column | None, high: Column | None) -> Column:
    return F.filter(words, lambda w: (F.lit(True) if low is None else w["x0"] >= low) & (F.lit(True) if high is None else w["x0"] < high))


def rolling_matrix(words: DataFrame) -> DataFrame:
    """(doc, school, program, level, year, status, points) of a matrix with a column for each of several years.

    A school's name stands in its first line and may go on in lines of its own, before or after rows that were already
    read: it holds for all rows of the group that the first line opens. The level is printed once a block and carried down. A
    page without header has the columns of the last page with one. A value belongs to the year whose column is nearest, and
    words of one cell are one text. Within a document, a name that begins exactly one longer name is that name.
    """
    t = F.col("text")
    year = F.when(t.rlike("^20[0-9]{2}$"), F.struct("top", "x0", t.cast("int").alias("year")))
    columns = {"level": t == "Nivå", "program": F.startswith(t, F.lit("Programområde"))}
    heads = words.groupBy(*PAGE).agg(*[_last_x(test).alias(c) for c, test in columns.items()], F.array_sort(F.collect_list(year)).alias("years"))
    whole = (F.size("years") > 0) & F.col("program").isNotNull() & F.col("level").isNotNull()
    heads = _carried(heads.select(*PAGE, F.when(whole, F.struct("level", "program", "years")).alias("head")))
    lines = lines_of(words).where((t != "") & ~t.rlike("^(Skole |Poenggrense|•)")).join(heads, PAGE)
    level, program = F.col("head.level") - 4, F.col("head.program") - 4
    first = F.array_min(F.transform("head.years", lambda y: y["x0"])) - 8
    w = F.col("words")
    lines = lines.select(
        *PAGE, "line", "head",
        _joined(_between(w, None, level)).alias("name"),
        F.get(_between(w, level, program), F.lit(0))["text"].alias("digit"),
        _joined(_between(w, program, first)).alias("label"),
        _between(w, first, None).alias("values"),
    )
    goes_on = (F.col("name") != "") & (F.col("label") == "") & (F.size("values") == 0)
    opens = (F.col("name") != "") & ~goes_on
    order = Window.partitionBy("doc").orderBy("page", "line").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumns({
        "group": F.sum(F.when(opens, 1).otherwise(0)).over(order),
        "level": F.coalesce(F.last(F.when(~goes_on & F.col("digit").rlike("^[1-4]$"), F.concat(F.lit("Vg"), "digit")), ignorenulls=True).over(order), F.lit("Vg1")),
        "part": F.when(opens | goes_on, F.struct("page", "line", F.col("name").alias("text"))),
    })
    parts = F.array_sort(F.collect_list("part").over(Window.partitionBy("doc", "group")))
    rows = lines.withColumns({"school": _joined(parts), "program": _once(F.col("label"), program_name)}).where((F.col("group") > 0) & (F.col("label") != ""))

    def column(value: Column) -> Column:
        far = F.transform("head.years", lambda y, i: F.struct(F.abs(y["x0"] + 14 - (value["x0"] + value["x1"]) / 2).alias("d"), i.alias("i")))
        return F.struct(value["text"].alias("text"), F.array_min(far)["i"].alias("i"))

    placed = rows.withColumn("values", F.transform("values", column))
    cells = F.transform("head.years", lambda y, i: F.struct(y["year"].alias("year"), _joined(F.filter("values", lambda v: v["i"] == i)).alias("cell")))
    cells = placed.select("doc", "school", "program", "level", F.inline(cells)).where("cell <> ''")
    cells = cells.select("doc", "school", "program", "level", "year", _once(F.col("cell"), lambda c: classified(c, 0.0)).alias("v")).where("v.status is not null")
    cells = cells.select("doc", "school", "program", "level", "year", "v.*")
    return prefix_renamed(cells, "school", ["doc"]).drop("school").withColumnRenamed("renamed", "school").select(cells.columns)


def code_matrix(words: DataFrame, register: DataFrame) -> DataFrame:
    """(doc, number, school, program, level, status, points) of a matrix whose columns are headed by programme codes.

    Rows begin with a date of eight digits, then the school's number, often grown together with its name. A value belongs to
    the last code that begins at most 8 right of its centre; the code's name is a local one or that of ``register`` (code,
    nob), and values under unknown codes are left out. A page without codes is none of the table.
    """
    code = F.col("text").rlike("^[A-ZÆØÅ]{5}[0-9][A-Z0-9-]{4}$")
    heads = words.where(code).groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("x0", F.col("text").alias("code")))).alias("codes"))
    rest = F.slice("words", F.lit(2), F.size("words"))
    lines = lines_of(words).where(F.get("words", F.lit(0))["text"].rlike("^[0-9]{8}$")).withColumn("words", rest).join(heads, PAGE)
    is_value = lambda w: w["text"].rlike(r"^([0-9]{1,2}(,[0-9])?|\*)$")
    names = F.filter("words", lambda w: ~is_value(w))
    numbered = _once(_joined(names), numbered_school)
    under = lambda v: F.array_max(F.filter("codes", lambda c: c["x0"] <= (v["x0"] + v["x1"]) / 2 + 8))["code"]
    values = F.transform(F.filter("words", is_value), lambda v: F.struct(under(v).alias("code"), v["text"].alias("cell")))
    cells = lines.select("doc", numbered["number"].alias("number"), numbered["school"].alias("school"), F.inline(values))
    cells = cells.withColumn("school", _once(F.col("school"), school_identity)["school"]).where("school <> '' and code is not null")
    cell = F.when(F.col("cell") == "*", F.struct(F.lit("open").alias("status"), F.lit(None).cast("double").alias("points"))).otherwise(_once(F.col("cell"), lambda c: classified(c, 0.0)))
    program = _once(F.col("title"), program_name)
    named = code_titles(cells, register).where("title is not null")
    named = named.select("doc", "number", "school", program.alias("program"), cell.alias("v")).where("v.status is not null")
    return named.select("doc", "number", "school", "program", level_of(F.col("program"), F.lit("Vg1")).alias("level"), "v.*")


def listed_thresholds(words: DataFrame) -> DataFrame:
    """(doc, layout, school, program, level, status, points) of lists of school, programme and threshold, in three layouts.

    A page's header tells the layout: ``level`` has a column of levels between programme and threshold, ``block`` names the
    block's level there instead, ``plain`` has neither; a page without header goes on in the last one's. The threshold is
    what the longest run of a line's last words (four at most) means; a digit before it that is right of the programme's
    column is the level, else the level is that of the last line that named one. A later line for the same school, programme
    and level replaces an earlier one.
    """
    t = F.lower("text")
    tests = {"program": F.startswith(t, F.lit("programområde")), "digit": t.isin("nivå", "nivaa"), "block": t == "vg1", "value": t == "nedre"}
    any_test = reduce(lambda a, b: a | b, tests.values())
    heads = words.where(any_test).groupBy(*PAGE).agg(
        *[_last_x(tests[c]).alias(c) for c in ("program", "value")], *[F.collect_set(F.when(tests[c], F.col("x0"))).alias(c) for c in ("digit", "block")]
    )
    between = lambda c: F.exists(c, lambda x: (x > F.col("program")) & (x < F.col("value")))
    layout = F.when(between("digit"), "level").when(between("block"), "block").otherwise("plain")
    head = F.when(F.col("program").isNotNull() & F.col("value").isNotNull(), F.struct("program", layout.alias("layout")))
    heads = _carried(words.select(*PAGE).distinct().join(heads.select(*PAGE, head.alias("head")), PAGE, "left"))
    named = F.nullif(F.regexp_extract("text", r"(?i)^Vg\s?([1-4])\b", 1), F.lit(""))
    size = F.size("words")
    tails = F.array(*[F.when(size >= k, _joined(F.slice("words", -k, k))) for k in range(1, TAIL + 1)])
    heading = F.lower("text").rlike("^(skule|skole|oversikt|nedre poenggrense)")
    # a page's lines lie where its words were dealt to; the few headers are looked up there, and lines are not sorted for it
    lines = lines_of(words).join(heads.hint("shuffle_hash"), PAGE)
    lines = stored(lines.select(*PAGE, "line", "head", named.alias("named"), heading.alias("heading"), "words", tails.alias("tails")), "lines")
    # a document's blocks go on over its pages: what goes through a window of a document are its pages and not its lines
    marks = lines.where("named is not null").groupBy(*PAGE).agg(F.sort_array(F.collect_list(F.struct("line", "named"))).alias("marks"))
    before = Window.partitionBy("doc").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    pages = lines.select(*PAGE).distinct().join(marks, PAGE, "left")
    pages = pages.withColumn("before", F.last(F.element_at("marks", -1)["named"], ignorenulls=True).over(before))
    lines = lines.where("named is null and not heading")
    # few texts are different: each is understood once
    known = lines.select(F.explode("tails").alias("text")).distinct().select("text", classified(F.col("text"), 0.0).alias("v"))
    known = stored(known, "meanings").where("v.status is not null")
    for k in range(1, TAIL + 1):
        lines = lines.join(known.select(F.col("text").alias(f"t{k}"), F.col("v").alias(f"v{k}")), F.get("tails", F.lit(k - 1)) == F.col(f"t{k}"), "left")
    longest = F.coalesce(*[F.when(F.col(f"v{k}").isNotNull(), F.struct(F.lit(k).alias("k"), F.col(f"v{k}").alias("v"))) for k in range(TAIL, 0, -1)])
    lines = lines.withColumn("tail", longest).where("tail is not null").withColumn("body", F.slice("words", F.lit(1), size - F.col("tail.k"))).where(F.size("body") > 0)
    last = F.element_at("body", -1)
    digit = F.when(last["text"].rlike("^[1-4]$") & (last["x0"] > F.col("head.program")), last["text"])
    lines = lines.withColumn("digit", digit).withColumn("body", F.when(F.col("digit").isNotNull(), F.slice("body", F.lit(1), F.size("body") - 1)).otherwise(F.col("body")))
    edge = F.col("head.program") - 4
    rows = lines.select(
        *PAGE, "line", "head.layout", _joined(_between(F.col("body"), None, edge)).alias("school"),
        _joined(_between(F.col("body"), edge, None)).alias("printed"), "digit", "tail.v",
    )
    rows = stored(rows, "rows").where("school <> ''")
    programs = rows.select("printed").distinct().select("printed", program_name(F.col("printed")).alias("program"))
    rows = rows.join(stored(programs, "programs").where("program <> ''"), "printed").join(pages, PAGE, "left")
    above = F.array_max(F.filter("marks", lambda m: m["line"] < F.col("line")))
    block = F.when(F.size("marks") > 0, above["named"])
    level = F.concat(F.lit("Vg"), F.coalesce("digit", block, "before", F.lit("1")))
    rows = rows.select("doc", "layout", "school", "program", level.alias("level"), F.struct("page", "line").alias("at"), "v")
    kept = rows.groupBy("doc", "school", "program", "level").agg(F.max_by(F.struct("layout", "v"), "at").alias("kept"))
    return kept.select("doc", "kept.layout", "school", "program", "level", "kept.v.*")


def words_at(glyphs: DataFrame, tolerances: tuple[float, ...]) -> DataFrame:
    """(doc, page, line, attempt, text, x0, x1, top): glyphs to words, once for each tolerance.

    A word ends where the next glyph of its line begins more than the tolerance after it; ``attempt`` numbers the tolerances.
    """
    tried = glyphs.withColumn("t", F.explode(F.array(*[F.struct(F.lit(i).alias("attempt"), F.lit(t).alias("most")) for i, t in enumerate(tolerances)])))
    own = [*PAGE, "line", "attempt"]
    w = Window.partitionBy(*own).orderBy("x0")
    tried = tried.select("*", "t.*").withColumn("_new", F.when(F.col("x0") - F.lag("x1").over(w) > F.col("most"), 1).otherwise(0))
    tried = tried.withColumn("word", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "text"))), lambda g: g["text"]), "")
    return tried.groupBy(*own, "word").agg(text.alias("text"), F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("top").alias("top")).drop("word")


CELL = r"^([0-9]{1,2}(,[0-9]{1,2})?|\*{1,3})$"


def rotated_matrix(glyphs: DataFrame, tolerances: tuple[float, ...] = (3.0, 1.5)) -> DataFrame:
    """(doc, school, program, level, status, points) of a matrix whose labels stand upright, from single glyphs.

    Words are made at every tolerance in one pass; a page takes the first at which a school's number of four digits stands
    at its left edge, and pages with none at any are left out. Columns are where the values are: chains of centres at most 8
    apart. A label is what stands above its column in the font that most glyphs there have (of equals, the last by name),
    read from the bottom to the first gap, one upright line after the other. A name may run into a value: it is read without
    digits, and values are read from the glyphs under each column.
    """
    middle = (F.col("x0") + F.col("x1")) / 2
    lined = islands(glyphs.where(F.trim("text") != "").withColumn("cx", middle), PAGE, "top", 3.0, "line")
    words = stored(words_at(lined, tolerances), "words")  # within the pages as they were dealt for the lines
    number = F.col("text").rlike("^[0-9]{4}$") & (F.col("x0") < 60)
    valid = words.where(number).groupBy(*PAGE).agg(F.min(F.struct("attempt", "top")).alias("v"))
    valid = valid.select(*PAGE, F.col("v.attempt").alias("attempt"), F.col("v.top").alias("first"))
    used = words.join(valid, [*PAGE, "attempt"])
    cells = used.where((F.col("top") >= F.col("first") - 2) & F.col("text").rlike(CELL) & (middle > 100))
    columns = islands(cells.withColumn("cx", middle), PAGE, "cx", 8.0, "col").groupBy(*PAGE, "first", "col").agg(F.avg("cx").alias("c"))
    columns = columns.groupBy(*PAGE, "first").agg(F.collect_list(F.struct("col", "c")).alias("columns"))  # a row a page
    under = lined.join(columns, PAGE).withColumn("col", F.explode(F.filter("columns", lambda k: F.abs(k["c"] - F.col("cx")) <= 9))).withColumn("col", F.col("col.col"))
    under = stored(under.select(*PAGE, "line", "col", "text", "x0", "cx", "top", "font", "first"), "under")

    own = [*PAGE, "col"]
    band = under.where((F.col("top") > 40) & (F.col("top") < F.col("first") - 4))
    band = band.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*own, "font")))
    band = band.withColumn("main", F.max(F.struct("n", "font")).over(Window.partitionBy(*own))).where(F.col("font") == F.col("main.font"))
    beside = islands(band, own, "cx", 3.0, "sub").withColumn("up", -F.col("top"))
    near = before_gap(beside, [*own, "sub"], "up", 12.0)
    label = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sub", "up", "x0", "text"))), lambda g: g["text"]), "")
    labels = near.groupBy(*own).agg(label.alias("label")).select(*own, _once(F.col("label"), program_name).alias("program")).where(F.length("program") >= 4)

    row = [*PAGE, "line"]
    named = used.where((F.col("x0") > 30) & (F.col("x0") < 124) & ~F.col("text").rlike(CELL)).groupBy(*row).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "text"))), lambda w: w["text"]), " ").alias("name")
    )
    school = _once(F.regexp_replace(without_digits(F.col("name")), r"\bvg\.\s*skole$", "videregående skole"), school_identity)["school"]
    named = named.join(used.where(number).select(*row).distinct(), row).select(*row, school.alias("school")).where("school <> ''")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "text"))), lambda g: g["text"]), "")
    values = under.where(F.col("text").rlike("^[0-9,*]$")).groupBy(*row, "col").agg(text.alias("cell")).where(F.col("cell").rlike(CELL))
    read = values.join(named, row).join(labels, own).withColumn("v", _once(F.col("cell"), lambda c: classified_symbols(c, 0.0))).where("v.status is not null")
    return read.select("doc", "school", "program", level_of(F.col("program"), F.lit("Vg1")).alias("level"), "v.*")


def two_cuts(cells: DataFrame) -> DataFrame:
    """(doc, school, program, level, status, points, r1_status, r1_points, round_note) of pages that print their figures twice.

    ``cells`` are (doc, table_no, row_no, col_no, text, heading). Tables by programme are headed "... – programme" and list
    schools; tables by school are headed by its name, their first column is "Utdanningsprogram", and list programmes. Both
    have a column for each of two rounds, in any order. The second round counts; where it has no value the first does, with
    ``round_note`` '1'. Of cells for one school and programme, in whatever cut and case, the first of the page counts.
    """
    table_of = ["doc", "table_no"]
    text = squash(F.col("text"))
    header = F.array_sort(F.collect_list(F.when(F.col("row_no") == 0, F.struct("col_no", F.lower(text).alias("text")))))
    tables = cells.groupBy(*table_of).agg(F.first("heading").alias("heading"), header.alias("header"))

    def place(mark: str, default: int) -> Column:
        return F.coalesce(F.get(F.filter("header", lambda h: F.contains(h["text"], F.lit(mark))), F.lit(0))["col_no"], F.lit(default))

    by_school = F.startswith(F.get("header", F.lit(0))["text"], F.lit("utdanningsprogram"))
    tables = tables.select(
        *table_of, by_school.alias("by_school"), place("1.", 1).alias("i1"), place("2.", 2).alias("i2"),
        F.when(by_school, squash(F.regexp_replace("heading", r"(?i)\bvgs\.?$", ""))).alias("own_school"),
        F.when(~by_school & F.contains("heading", F.lit("–")), _once(F.regexp_replace("heading", "^[^–]*–", ""), program_name)).alias("own_program"),
    )
    rows = cells.where("row_no > 0").join(tables.where("coalesce(own_school, own_program, '') <> ''"), table_of)
    at = lambda i: F.max(F.when(F.col("col_no") == i, text))
    rows = rows.groupBy(*table_of, "row_no", "by_school", "own_school", "own_program").agg(
        at(F.lit(0)).alias("first"), at(F.col("i1")).alias("c1"), at(F.col("i2")).alias("c2")
    )
    rows = rows.where("first <> '' and c1 is not null and c2 is not null").where(~F.startswith(F.lower("first"), F.lit("poenggrense 0,0")))
    rows = rows.select(
        *table_of, "row_no", F.when(F.col("by_school"), F.col("own_school")).otherwise(F.col("first")).alias("school"),
        F.when(F.col("by_school"), _once(F.col("first"), program_name)).otherwise(F.col("own_program")).alias("program"),
        classified(F.col("c1"), 0.0).alias("v1"), classified(F.col("c2"), 0.0).alias("v2"),
    )
    rows = rows.where("program <> '' and (v1.status is not null or v2.status is not null)")
    first = F.min_by(F.struct("program", "v1", "v2"), F.struct("table_no", "row_no")).alias("f")
    kept = rows.groupBy("doc", "school", F.lower("program").alias("_key")).agg(first).select("doc", "school", "f.*")
    only_first = F.col("v2.status").isNull()
    return kept.select(
        "doc", "school", "program", level_of(F.col("program"), F.lit("Vg1")).alias("level"),
        F.coalesce("v2.status", "v1.status").alias("status"), F.when(only_first, F.col("v1.points")).otherwise(F.col("v2.points")).alias("points"),
        F.col("v1.status").alias("r1_status"), F.col("v1.points").alias("r1_points"), F.when(only_first, "1").alias("round_note"),
    )

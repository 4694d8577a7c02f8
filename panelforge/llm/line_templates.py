"""Line dedup by a log-template tree of fixed depth.

The tree's first level is a line's number of tokens, the next ``DEPTH`` levels are its leading tokens, where tokens
with a digit count as a variable ``<*>``; a line of nothing but such tokens, a row of numbers, is taken as it stands, with
a node for each different one, so that only a repeat of the same numbers recurs. Of each node that holds lines of at least ``min_docs`` different texts, a
template is made: at each position the token that more than ``CONSTANT`` of the node's lines share, or ``<*>`` where
there is none. A line belongs to the node's template if at least ``SIMILAR`` of its tokens equal it, one that is no
variable among them. The lines that do
not are split by their token at the position where the node has the fewest different ones (but more than one), and the
new nodes are treated in the same way, ``SPLITS`` times; so a node that mixes several templates gives each its own. Lines
that no template on their way covers keep their own masked tokens as template. Templates found in at least ``min_docs``
different texts are recurring: their lines stay in the document with the smallest id and are dropped from all others.

Texts that are equal as a whole count as one, so a copied document is not taken for a recurring line. Everything is
DataFrame operations: counts are aggregated before they are shuffled, and only the lines of recurring leaves and, once,
the documents are moved. Leaves, templates and recurring keys are written as tables of their own before lines are joined to
them, so that adaptive execution knows their size: small ones are broadcast, and a key with a large share of all lines is
split among tasks.

Defined cases: a null text stays null; lines without a token are never dropped; a document may lose all lines and then
has an empty text; a null doc_id counts as larger than all others; repeated rows are treated alike and stay; an empty
table gives an empty result; other columns are kept as they are, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm.common import materialise, quoted, scratch, table

DEPTH = 3
CONSTANT = 0.5
SIMILAR = 0.7
SPLITS = 2
#: Words of 64 bits by which lines of leaves that cannot recur are told before they are moved; bounds what is broadcast. A power of 2.
WORDS = 1 << 20
#: A line that a second text repeats is recurring; texts that are equal as a whole count as one.
MIN_DOCS = 2
BLANKS = "[ \\t\\r]+"


def _tokens(line: Column, limit: int = -1) -> Column:
    """The tokens of a line of ``_lines``; ``limit`` leaves what follows so many in one piece."""
    # one blank is split without a regular expression
    return F.split(line, " ", limit)


def _numbers(tokens: Column) -> Column:
    return F.forall(tokens, lambda t: t.rlike("[0-9]"))


def _masked(tokens: Column) -> Column:
    return F.transform(tokens, lambda t: F.when(t.rlike("[0-9]"), F.lit("<*>")).otherwise(t))


def _lines(docs: DataFrame) -> DataFrame:
    """Every line that has a token, one blank between its tokens, with its document (id, digest of the text), number and leaf."""
    blanks = reduce(Column.__or__, [F.contains("text", F.lit(b)) for b in ("  ", "\t", "\r")])
    single = F.when(blanks, F.regexp_replace("text", BLANKS, " ")).otherwise(F.col("text"))
    # the digest is made before lines are, so that a text is hashed once and not once a line
    texts = docs.where("text is not null").select(F.col("doc_id").alias("doc"), F.xxhash64("text").alias("content"), single.alias("text"))
    lines = texts.select("doc", "content", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    # tokens are counted by blanks and looked for one without a digit; only the leading ones are cut out
    n = F.octet_length("line") - F.octet_length(F.replace("line", F.lit(" "), F.lit(""))) + 1
    words = F.rlike("line", F.lit("(?:^| )[^ 0-9]+(?: |\\z)"))
    lead = F.when(words, _masked(F.slice(_tokens(F.col("line"), DEPTH + 1), 1, DEPTH))).otherwise(_tokens(F.col("line")))
    return lines.withColumn("line", F.btrim("line", F.lit(" "))).where("line <> ''").withColumn("leaf", F.xxhash64(n, lead))


def _recurring(rows: DataFrame, key: str, min_docs: int) -> DataFrame:
    """Keys found in at least ``min_docs`` different texts, and the smallest document that has each."""
    contents = rows.groupBy(key, "content").agg(F.min("doc").alias("doc"))
    return (
        contents.groupBy(key)
        .agg(F.count(F.lit(1)).alias("_n"), F.min("doc").alias("first"))
        .where(F.col("_n") >= min_docs)
        .drop("_n")
    )


def _templates(lines: DataFrame) -> DataFrame:
    """(leaf, leaf_template, split): the template of each leaf, and the position by which to split what it leaves over."""
    counts = (
        lines.select("leaf", F.posexplode("tokens").alias("at", "token"))
        .groupBy("leaf", "at", "token")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    positions = counts.groupBy("leaf", "at").agg(
        F.sum("n").alias("of"), F.count(F.lit(1)).alias("kinds"), F.max_by("token", F.struct("n", "token")).alias("top"), F.max("n").alias("n")
    )
    shared = F.when(F.col("n") > CONSTANT * F.col("of"), F.col("top")).otherwise(F.lit("<*>"))
    found = positions.groupBy("leaf").agg(
        F.array_sort(F.collect_list(F.struct("at", shared.alias("token")))).alias("t"),
        F.min(F.when(F.col("kinds") > 1, F.struct("kinds", "at"))).alias("split"),
    )
    return found.select("leaf", F.transform("t", lambda x: x["token"]).alias("leaf_template"), F.col("split.at").alias("split"))


def _perhaps_of(lines: DataFrame, leaves: DataFrame) -> DataFrame:
    """All lines of ``leaves`` and few others: those whose bit, of ``WORDS`` words of 64, some leaf of ``leaves`` sets.

    At most ``WORDS`` rows of two numbers are broadcast, however many leaves there are; with more leaves than bits more
    lines pass, but none of ``leaves`` is ever lost.
    """
    # never null, unlike a remainder: a filter on that would make leaves of all lines a second time
    word, bit = F.col("leaf").bitwiseAND(WORDS - 1).alias("word"), F.expr("cast(shiftrightunsigned(leaf, 24) & 63 AS int)")
    bits = leaves.select(word, bit.alias("bit")).groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
    marked = lines.withColumn("word", word).join(F.broadcast(bits), "word")
    return marked.where(F.getbit("bits", bit) == 1).drop("word", "bits")


def _of_recurring_leaves(lines: DataFrame, min_docs: int) -> DataFrame:
    """The lines whose leaf has lines of ``min_docs`` texts; equal lines are always of one leaf, so others cannot recur."""
    leaves = _recurring(lines.select("leaf", "content", "doc"), "leaf", min_docs).select("leaf")
    leaves = materialise(leaves, "leaves")
    return _perhaps_of(lines, leaves).join(leaves, "leaf")


def _keyed(lines: DataFrame, min_docs: int) -> DataFrame:
    """(doc, content, line_no, template) of every line that may recur."""
    # the lines move as they are; tokens, which take more room, are made afterwards
    rest = _of_recurring_leaves(lines, min_docs).withColumn("tokens", _tokens(F.col("line"))).drop("line")
    rest = rest.withColumn("tokens", F.when(_numbers(F.col("tokens")), F.col("tokens")).otherwise(_masked(F.col("tokens"))))
    rest, found = materialise(rest, "lines"), []
    same = F.aggregate(
        F.zip_with("tokens", "leaf_template", lambda a, b: (a == b).cast("int")), F.lit(0), lambda acc, x: acc + x
    )
    constant = F.exists(F.arrays_zip("tokens", "leaf_template"), lambda p: (p["tokens"] == p["leaf_template"]) & (p["tokens"] != "<*>"))
    covered = (same >= SIMILAR * F.size("tokens")) & constant
    by_leaf, own = F.xxhash64(F.lit(1), "leaf"), F.xxhash64(F.lit(0), "tokens")
    for _ in range(SPLITS):
        # a column of its own, so that a line is compared once
        tried = rest.join(materialise(_templates(rest), "leaf-templates"), "leaf").withColumn("covered", covered).select(
            "doc",
            "content",
            "line_no",
            F.when(F.col("covered"), by_leaf).alias("template"),
            F.when(~F.col("covered"), F.xxhash64("leaf", "split", F.get("tokens", "split"))).alias("leaf"),
            F.when(~F.col("covered"), F.col("tokens")).alias("tokens"),
        )
        tried = materialise(tried, "tried")
        found.append(tried.where("template is not null").drop("leaf", "tokens"))
        rest = _of_recurring_leaves(tried.where("template is null").drop("template"), min_docs)
    last = rest.join(materialise(_templates(rest), "leaf-templates"), "leaf").select(
        "doc", "content", "line_no", F.when(covered, by_leaf).otherwise(own).alias("template")
    )
    return reduce(DataFrame.unionByName, [*found, last])


def dropped_lines(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc, content, dropped array<int>): numbers from 0 of the lines to drop, for documents that lose any."""
    with scratch("templates"):
        keyed = materialise(_keyed(_lines(docs), min_docs), "templates")
    recurring = materialise(_recurring(keyed, "template", min_docs), "recurring")
    return (
        keyed.join(recurring, "template")
        .where(~F.col("doc").eqNullSafe(F.col("first")))
        .groupBy("doc", "content")
        .agg(F.collect_set("line_no").alias("dropped"))
    )


def drop_lines(docs: DataFrame, min_docs: int = MIN_DOCS, counts: tuple[str, str] | None = ("_lines", "_dropped")) -> DataFrame:
    """``docs`` (doc_id, text and any others) with recurring lines dropped from text.

    ``counts`` names two more columns, the lines of a text and those dropped; they replace columns of these names.
    """
    found, own = dropped_lines(docs, min_docs).alias("gone_lines"), docs.alias("own")
    of = lambda name: F.col(f"own.{quoted(name)}")
    joined = own.join(
        found,
        of("doc_id").eqNullSafe(F.col("gone_lines.doc")) & (F.xxhash64(of("text")) == F.col("gone_lines.content")),
        "left",
    )
    lines, gone = F.split(of("text"), "\n"), F.col("gone_lines.dropped")
    places = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    # a map of one split text, not a split for each place
    kept = F.get(F.transform(F.array(lines), lambda parts: F.array_join(F.transform(places, lambda i: F.get(parts, i)), "\n")), 0)
    text = F.when(gone.isNull(), of("text")).otherwise(kept).alias("text")
    numbers = []
    if counts:
        numbers = [
            F.when(of("text").isNull(), F.lit(0)).otherwise(F.size(lines)).alias(counts[0]),
            F.when(gone.isNull(), F.lit(0)).otherwise(F.size(gone)).alias(counts[1]),
        ]
    return joined.select(*[text if c == "text" else of(c) for c in docs.columns if c not in (counts or ())], *numbers)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id",
        F.col("_lines").cast("bigint").alias("n_lines"),
        F.col("_dropped").cast("bigint").alias("n_dropped"),
        F.sha2("text", 256).alias("kept_sha256"),
    )


def keep_new_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` with the lines of recurring templates dropped from their texts; all rows stay."""
    out = drop_lines(docs, counts=None)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in out.columns else out


def _level_sql(i: int) -> str:
    """One level of the tree: nodes{i} to tried{i}, whose uncovered lines are nodes{i + 1}."""
    return f"""
counts{i} AS (
  SELECT key, pos, token, count(*) AS c
  FROM (SELECT key, generate_subscripts(tokens, 1) AS pos, unnest(tokens) AS token FROM nodes{i}) GROUP BY ALL),
positions{i} AS (
  SELECT key, pos, kinds, CASE WHEN c > {CONSTANT} * total THEN token ELSE '<*>' END AS token
  FROM (SELECT *, sum(c) OVER (PARTITION BY key, pos) AS total, count(*) OVER (PARTITION BY key, pos) AS kinds,
          row_number() OVER (PARTITION BY key, pos ORDER BY c DESC) AS k FROM counts{i}) WHERE k = 1),
templates{i} AS (
  SELECT key, list(token ORDER BY pos) AS template, (min({{'kinds': kinds, 'pos': pos}}) FILTER (kinds > 1)).pos AS split
  FROM positions{i} GROUP BY key),
tried{i} AS (
  SELECT nodes{i}.*, split,
    len(list_filter(list_zip(tokens, template), lambda p: p[1] = p[2])) >= {SIMILAR} * len(tokens)
      AND len(list_filter(list_zip(tokens, template), lambda p: p[1] = p[2] AND p[1] <> '<*>')) > 0 AS covered
  FROM nodes{i} JOIN templates{i} USING (key)),
rest{i} AS (
  SELECT doc_id, content, line_no, tokens, key || chr(3) || split || chr(2) || tokens[split] AS key
  FROM tried{i} WHERE NOT covered),
nodes{i + 1} AS (
  SELECT * FROM rest{i} WHERE key IN (SELECT key FROM rest{i} GROUP BY key HAVING count(DISTINCT content) >= {MIN_DOCS})),"""


ORACLE_SQL = f"""
WITH lines AS (
  SELECT doc_id, md5(text) AS content, generate_subscripts(parts, 1) - 1 AS line_no, unnest(parts) AS line
  FROM (SELECT doc_id, text, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL)),
tok AS (
  SELECT doc_id, content, line_no,
    list_filter(string_split_regex(line, '[ \\t\\r]+'), lambda x: x <> '') AS raw FROM lines),
marked AS (SELECT *, len(list_filter(raw, lambda x: NOT regexp_matches(x, '[0-9]'))) = 0 AS numbers FROM tok WHERE len(raw) > 0),
masked AS (
  SELECT doc_id, content, line_no, numbers,
    CASE WHEN numbers THEN raw ELSE list_transform(raw, lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) END AS tokens FROM marked),
t AS (
  SELECT *, len(tokens) || chr(1) || array_to_string(CASE WHEN numbers THEN tokens ELSE list_slice(tokens, 1, {DEPTH}) END, chr(2)) AS key FROM masked),
nodes0 AS (SELECT * FROM t WHERE key IN (SELECT key FROM t GROUP BY key HAVING count(DISTINCT content) >= {MIN_DOCS})),
{"".join(map(_level_sql, range(SPLITS + 1)))}
keyed AS (
  {" UNION ALL ".join(f"SELECT doc_id, content, line_no, 'leaf' || chr(1) || key AS template FROM tried{i} WHERE covered" for i in range(SPLITS + 1))}
  UNION ALL
  SELECT doc_id, content, line_no, 'own' || chr(1) || array_to_string(tokens, chr(2)) FROM tried{SPLITS} WHERE NOT covered),
recurring AS (
  SELECT template, min(doc_id) AS first FROM keyed GROUP BY template HAVING count(DISTINCT content) >= {MIN_DOCS}),
gone AS (
  SELECT k.doc_id, k.line_no FROM keyed k JOIN recurring r USING (template) WHERE k.doc_id <> r.first),
kept AS (
  SELECT l.doc_id, count(*) AS n_lines, count(g.line_no) AS n_dropped,
    string_agg(l.line, chr(10) ORDER BY l.line_no) FILTER (g.line_no IS NULL) AS text
  FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.line_no = g.line_no GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_dropped, 0) AS n_dropped,
  CASE WHEN d.text IS NOT NULL THEN sha256(coalesce(k.text, '')) END AS kept_sha256
FROM documents d LEFT JOIN kept k USING (doc_id)
"""

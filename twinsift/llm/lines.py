"""Line deduplication by a tree of log templates, in DataFrame operations only.

Lines (split at new lines, tokens split at single blanks) go down a tree of fixed depth:
first by their number of tokens, then by their leading tokens, where a token with a digit is
a variable. In leaves that enough documents reach, the tokens that too few lines of the leaf
have at their position are variable too; what remains is the line's template, if enough is
constant, past the leading tokens as well. Lines of a template that recurs across documents are
dropped, but for its first line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import unused, written

#: A template recurs from this many documents on; a token is constant from this many lines on.
MIN_DOCUMENTS = 10
#: Leading tokens that the tree looks at; shorter lines are told apart by the tokens that they have.
DEPTH = 3
#: The least part of a recurring template's tokens that is constant; also of those past the leading ones, which all
#: lines of a leaf share anyway. There tokens with digits do not count, as lines that differ in them only are alike.
CONSTANT = 0.5
VARIABLE = "<*>"

_KEY = ["id", "print"]


def _lines(rows: DataFrame) -> DataFrame:
    lines = rows.select(*_KEY, F.posexplode(F.split("text", "\n")).alias("at", "line")).where(F.trim("line") != "")
    tokens = F.length("line") - F.length(F.replace("line", F.lit(" "), F.lit(""))) + 1
    head = F.split("line", " ", DEPTH + 1)
    # a null past a shorter line's end adds nothing to the hash, which has the number of tokens
    leading = [F.get(head, F.lit(i)) for i in range(DEPTH)]
    lead = [F.when(t.rlike("[0-9]"), VARIABLE).otherwise(t) for t in leading]
    return lines.withColumn("leaf", F.xxhash64(tokens, *lead))


def _recurring(rows: DataFrame, min_documents: int) -> DataFrame:
    """id, print (key of the row) and at (line number from 0) of the lines to drop, of ``rows`` (id, print, text).

    What is joined to the lines is written first: a side that is no aggregate lets the join
    split the rows of a line, leaf or template that a great part of the documents has.
    """
    lines = _lines(rows)
    leaves = written(lines.select(*_KEY, "leaf").distinct().groupBy("leaf").count().where(F.col("count") >= min_documents).select("leaf"))
    found = lines.join(leaves, "leaf", "left_semi")
    found = found.withColumn("line", F.regexp_replace("line", "[^ ]*[0-9][^ ]*", VARIABLE))
    found = written(found.withColumn("variant", F.xxhash64("line")))
    variants = found.groupBy("leaf", "variant").agg(F.first("line").alias("line"), F.count("*").alias("n"))
    tokens = written(variants.select("leaf", "variant", "n", F.posexplode(F.split("line", " ")).alias("pos", "token")))
    constant = tokens.groupBy("leaf", "pos", "token").agg(F.sum("n").alias("support"))
    constant = constant.where((F.col("support") >= min_documents) & (F.col("token") != VARIABLE)).drop("support").withColumn("constant", F.lit(True))
    marked = tokens.join(constant, ["leaf", "pos", "token"], "left")
    shown = F.when(F.col("constant"), F.col("token")).otherwise(VARIABLE)
    past = F.col("pos") >= DEPTH
    templates = marked.groupBy("leaf", "variant").agg(
        F.array_sort(F.collect_list(F.struct("pos", shown.alias("shown")))).alias("shape"), F.count("constant").alias("kept"), F.count("*").alias("all"),
        F.count(F.when(past, F.col("constant"))).alias("kept_past"), F.count(F.when(past & (F.col("token") != VARIABLE), 1)).alias("words_past"),
    )
    enough = (F.col("kept") >= CONSTANT * F.col("all")) & (F.col("kept_past") >= CONSTANT * F.col("words_past"))
    templates = written(templates.where(enough).select("leaf", "variant", F.xxhash64("leaf", "shape").alias("template")))
    placed = written(found.select(*_KEY, "at", "leaf", "variant").join(templates, ["leaf", "variant"]).select(*_KEY, "at", "template"))
    per_document = placed.groupBy("template", *_KEY).agg(F.min("at").alias("at"))
    recurring = per_document.groupBy("template").agg(F.count("*").alias("documents"), F.min(F.struct(*_KEY, "at")).alias("first"))
    recurring = written(recurring.where(F.col("documents") >= min_documents).drop("documents"))
    line = F.struct(*_KEY, "at")
    return placed.join(recurring, "template").where(~line.eqNullSafe(F.col("first"))).select(*_KEY, "at")


def drop_recurring_lines(docs: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """``docs`` with recurring lines taken out of text, and n_lines and n_dropped added.

    A null text stays null and has no lines; a text all of whose lines go is empty; blank lines
    stay. Repeated rows lose the same lines and count as one document. All other columns are
    untouched, whatever their names; where one is called n_lines or n_dropped, what is added has
    underscores behind that name. No rows give none.
    """
    # the row travels as one column, so that no name of its columns can clash
    rows = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("print"), "text", F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("row"))
    drops = _recurring(rows.select(*_KEY, "text"), min_documents).groupBy(*_KEY).agg(F.array_sort(F.collect_set("at")).alias("drops"))
    drops = drops.withColumnsRenamed({"id": "of", "print": "hash"})
    joined = rows.join(drops, rows["id"].eqNullSafe(drops["of"]) & (rows["print"] == drops["hash"]), "left")
    kept = F.expr("array_join(filter(split(text, '\\n'), (line, at) -> not array_contains(drops, at)), '\\n')")
    text = F.when(F.col("drops").isNull(), F.col("text")).otherwise(kept)
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).cast("long")
    n_dropped = F.when(F.col("drops").isNull(), 0).otherwise(F.size("drops")).cast("long")
    columns = [text.alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns]
    return joined.select(*columns, n_lines.alias(unused("n_lines", docs.columns)), n_dropped.alias(unused("n_dropped", docs.columns)))


#: The same in DuckDB: doc_id, text, n_lines, n_dropped.
ORACLE_SQL = f"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents
), leafed AS (
  SELECT *, len(string_split(line, ' ')) AS n, list_transform(string_split(line, ' ')[1:{DEPTH}], lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '{VARIABLE}' ELSE t END) AS lead
  FROM lines WHERE trim(line) <> ''
), leaves AS (
  SELECT n, lead FROM leafed GROUP BY n, lead HAVING count(DISTINCT doc_id) >= {MIN_DOCUMENTS}
), found AS (
  SELECT doc_id, line_no, n, lead, regexp_replace(line, '[^ ]*[0-9][^ ]*', '{VARIABLE}', 'g') AS line FROM leafed JOIN leaves USING (n, lead)
), variants AS (
  SELECT n, lead, line, count(*) AS times FROM found GROUP BY n, lead, line
), tokens AS (
  SELECT n, lead, line, times, generate_subscripts(string_split(line, ' '), 1) AS pos, unnest(string_split(line, ' ')) AS token FROM variants
), constant AS (
  SELECT n, lead, pos, token FROM tokens WHERE token <> '{VARIABLE}' GROUP BY n, lead, pos, token HAVING sum(times) >= {MIN_DOCUMENTS}
), templates AS (
  SELECT t.n, t.lead, t.line, list(CASE WHEN c.token IS NULL THEN '{VARIABLE}' ELSE t.token END ORDER BY t.pos) AS shape
  FROM tokens t LEFT JOIN constant c ON t.n = c.n AND t.lead = c.lead AND t.pos = c.pos AND t.token = c.token
  GROUP BY t.n, t.lead, t.line HAVING count(c.token) >= {CONSTANT} * count(*)
    AND count(c.token) FILTER (WHERE t.pos > {DEPTH}) >= {CONSTANT} * count(*) FILTER (WHERE t.pos > {DEPTH} AND t.token <> '{VARIABLE}')
), placed AS (
  SELECT f.doc_id, f.line_no, f.lead, t.shape FROM found f JOIN templates t ON f.n = t.n AND f.lead = t.lead AND f.line = t.line
), recurring AS (
  SELECT lead, shape, min((doc_id, line_no)) AS earliest FROM placed GROUP BY lead, shape HAVING count(DISTINCT doc_id) >= {MIN_DOCUMENTS}
), drops AS (
  SELECT doc_id, list(DISTINCT line_no) AS gone FROM placed p JOIN recurring r ON p.lead = r.lead AND p.shape = r.shape WHERE (p.doc_id, p.line_no) <> r.earliest GROUP BY doc_id
)
SELECT d.doc_id, CAST(coalesce(len(string_split(d.text, chr(10))), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_dropped,
  CASE WHEN gone IS NULL THEN d.text ELSE coalesce(array_to_string(list_filter(string_split(d.text, chr(10)), lambda x, i: NOT list_contains(gone, i - 1)), chr(10)), '') END AS text
FROM documents d LEFT JOIN drops USING (doc_id)
"""

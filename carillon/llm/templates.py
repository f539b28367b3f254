"""Line dedup by a log-template tree, in DataFrame operations only.

Words with a digit become ``<*>``.  The tree has a fixed depth: a line's leaf is its number
of words and its first ``depth`` words.  Inside a leaf a word is fixed where two documents or more
have it at that place; a line with at least ``similarity`` fixed places is an
instance of the template that keeps its fixed words, takes the leaf's most frequent fixed word
where its own is not fixed, and ``<*>`` where no word is.

One rule says which templates recur, for lines of every length.  A line is expected by chance as often
as there are lines, times the frequencies of its first words at their places among all lines, carried on
to its whole number of words.  A template recurs if the documents that have it, besides the first,
are so many more than chance explains that the tail of a Poisson distribution (its Chernoff
bound) is below ``2 ** -evidence``.  So two documents are enough for a line of some seven words, a line
of three rare words takes three, and single words, which tell nothing beyond their frequency, never recur.

A template's lines are dropped, save for the first one in the document with the smallest id.  Near
copies of that document fare like it and are not counted, so that whole copies are
left to a near-duplicate stage, which knows them by what they share: with what documents before them have left out on both sides,
``copy`` of the words of both lie in lines of common templates.

Lines of leaves that one document alone reaches are left out before any text moves, and only distinct
lines of leaves with several of them are taken apart into words.  Hot lines and templates
are pre-aggregated, and joins are plain equi-joins that adaptive execution may split where a
leaf, a line, a template or a word is hot.

Defined results: lines end at ``\\n``; a text of any length is read as a whole; a
null text stays null and has no lines; null ids count as one id behind all others; rows with
equal id and text are one document and fare alike; an empty table gives no rows; other
columns, whatever their names, pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

DEPTH = 3
SIMILARITY = 0.75
#: Bits that chance must be beaten by: one in a million.
EVIDENCE = 20
#: A document is a near copy of another with so large a share of their words in common lines.
COPY = 0.8

_ID, _KEY = "__id", "__key"


def _identity(docs: DataFrame) -> list[Column]:
    """The id by which documents are ordered, and a hash of id and text that stands for the document."""
    number = F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1))
    return [number.alias(_ID), F.xxhash64(number, "text").alias(_KEY)]


#: SQL: the lines of ``text`` with single spaces and words with a digit as <*>, each with its
#: number of words.  Most lines have neither odd spaces nor digits and skip both replacements.
_LINES = (
    r"transform(split(text, '\\n'), l -> if(l RLIKE '[0-9\\t\\x0B\\f\\r]|  ', "
    r"regexp_replace(trim(regexp_replace(l, '[ \\t\\x0B\\f\\r]+', ' ')), '(?<![^ ])[^ 0-9]*+[0-9][^ ]*+', '<*>'), trim(l)))"
)
_WITH_WORDS = "transform({}, l -> struct(l AS line, octet_length(l) - octet_length(replace(l, ' ', '')) + 1 AS words))"


def _leaf(depth: int) -> Column:
    return F.xxhash64(F.col("l.words"), F.substring_index("l.line", " ", depth))


def _chance(spots: DataFrame, leaves: DataFrame, depth: int) -> DataFrame:
    """leaf, chance: the log (base 2) of how many lines like a leaf's are expected."""
    lines = float(max(spots.count(), 1))
    heads = lambda of: of.select("*", F.posexplode(F.split("head", " ")).alias("at", "word"))
    frequency = heads(spots.select("head")).groupBy("at", "word").agg(F.count("*").alias("lines"))
    rare = heads(leaves.select("leaf", "words", "head")).join(frequency, ["at", "word"]).groupBy("leaf", "words").agg(F.sum(F.log2(F.lit(lines) / F.col("lines"))).alias("bits"))
    return rare.select("leaf", (F.log2(F.lit(lines)) - F.col("bits") * F.col("words") / F.least("words", F.lit(depth))).alias("chance"))


def _evidence(others: Column, chance: Column) -> Column:
    """Bits by which so many documents more than one beat chance; 0 where they do not."""
    expected = F.pow(F.lit(2.0), chance)
    bits = others * (F.log2(others) - chance) - (others - expected) * F.log2(F.exp(F.lit(1.0)))
    return F.when(others > expected, bits).otherwise(0.0)


def recurring_lines(docs: DataFrame, depth: int = DEPTH, similarity: float = SIMILARITY, evidence: float = EVIDENCE, copy: float = COPY) -> DataFrame:
    """__key, pos: the lines of ``docs(doc_id, text)`` to drop."""
    known = docs.filter(F.col("text").isNotNull()).select(*_identity(docs), "text")
    # the outer forms: the others compute the array once more, to filter on its size
    places = known.select(_ID, _KEY, F.posexplode_outer(F.expr(_WITH_WORDS.format(_LINES))).alias("pos", "l"))
    spots = materialise(
        places.select(_ID, _KEY, "pos", _leaf(depth).alias("leaf"), F.xxhash64("l.line").alias("line_key"), "l.words", F.substring_index("l.line", " ", depth).alias("head")), "line-spots"
    )

    # leaves that two documents reach (counted by line, so none is missed)
    by_line = spots.select("leaf", "line_key", "words", "head", _KEY).distinct().groupBy("leaf", "line_key", "words", "head").agg(F.count("*").alias("docs"))
    leaves = by_line.groupBy("leaf", "words", "head").agg(F.sum("docs").alias("reached"), F.count("*").alias("variants")).filter("reached >= 2")
    leaves = materialise(leaves.select("leaf", "words", "head", "variants"), "line-leaves")

    distinct = known.select(F.explode_outer(F.expr(_WITH_WORDS.format(f"array_distinct({_LINES})"))).alias("l"))
    lines = (
        distinct.select(_leaf(depth).alias("leaf"), F.xxhash64("l.line").alias("line_key"), F.col("l.line").alias("line"))
        .join(leaves.select("leaf", "variants"), "leaf")
        # not by leaf, so that the join may be split; partly summed before it is dealt anew
        .groupBy("line_key", "line")
        .agg(F.count("*").alias("docs"), F.first("leaf").alias("leaf"), F.first("variants").alias("variants"))
    )
    lines = materialise(lines, "line-variants")
    # all words of a line that two documents have are fixed, so it is its own template
    alone = lines.filter("docs >= 2").select("leaf", "line_key", F.xxhash64("leaf", "line").alias("template"))

    place = F.posexplode(F.split("line", " ")).alias("at", "word")
    fixed = lines.filter("variants > 1").select("leaf", "docs", place).groupBy("leaf", "at", "word").agg(F.sum("docs").alias("n")).filter("n >= 2")
    usual = fixed.groupBy("leaf", "at").agg(F.min_by("word", F.struct(-F.col("n"), F.col("word"))).alias("usual"))
    several = (
        lines.filter("variants > 1 AND docs = 1")
        .select("leaf", "line_key", place)
        .join(fixed.select("leaf", "at", "word", F.lit(1).alias("is_fixed")), ["leaf", "at", "word"], "left")
        .join(usual, ["leaf", "at"], "left")
        .withColumn("part", F.when(F.col("is_fixed") == 1, F.col("word")).otherwise(F.coalesce("usual", F.lit("<*>"))))
        .groupBy("leaf", "line_key")
        .agg(
            F.array_sort(F.collect_list(F.struct("at", "part"))).alias("parts"),
            F.count("is_fixed").alias("fixed"),
            F.count("*").alias("n"),
        )
        .filter(F.col("fixed") >= F.lit(similarity) * F.col("n"))
        .select("leaf", "line_key", F.xxhash64("leaf", F.concat_ws(" ", F.col("parts.part"))).alias("template"))
    )
    found = spots.select(_ID, _KEY, "pos", "leaf", "line_key", "words").join(alone.unionByName(several), ["leaf", "line_key"])
    found = materialise(found.select(_ID, _KEY, "pos", "template", "leaf", "words"), "line-templates")

    # every document of a template of several, with the first of them
    in_docs = found.groupBy("template", "leaf", "words", _ID, _KEY).agg(F.min("pos").alias("pos"))
    shared = in_docs.groupBy("template").agg(F.min(F.struct(_ID, _KEY)).alias("f"), F.count("*").alias("docs")).filter("docs >= 2").select("template", F.col(f"f.{_KEY}").alias("first"))
    held = materialise(in_docs.join(shared, "template").select("template", "leaf", "words", _KEY, "first", "pos"), "line-shared")
    later = held.filter(F.col(_KEY) != F.col("first"))

    # near copies of first documents, by the words that no document before has
    borrowed = later.groupBy(_KEY).agg(F.sum("words").alias("borrowed"))
    once = F.sum("words") / F.count_if(F.col("pos") == 0)  # a row that comes several times is one document
    own = spots.groupBy(_KEY).agg(once.alias("words")).join(borrowed, _KEY, "left").select(_KEY, (F.col("words") - F.coalesce("borrowed", F.lit(0))).alias("own"))
    own = materialise(own, "line-own")
    both = later.groupBy("first", _KEY).agg(F.sum("words").alias("common")).join(own, _KEY).filter(F.col("common") >= copy * F.col("own"))
    copies = both.join(own.select(F.col(_KEY).alias("first"), F.col("own").alias("own_first")), "first").filter(F.col("common") >= copy * (F.col("own") + F.col("own_first")))
    copies = materialise(copies.select("first", _KEY, F.lit(True).alias("copied")), "line-copies")

    told = held.join(copies, ["first", _KEY], "left").withColumn("alike", F.coalesce("copied", F.col(_KEY) == F.col("first")))
    told = materialise(told.select("template", "leaf", _KEY, "pos", "alike"), "line-told")
    counted = told.filter("NOT alike").groupBy("template", "leaf").agg(F.count("*").cast("double").alias("others"))
    recurring = counted.join(_chance(spots, leaves, depth), "leaf").filter(_evidence(F.col("others"), F.col("chance")) >= evidence).select("template")
    spots_of = told.join(recurring, "template", "left_semi").select("template", _KEY, F.when(F.col("alike"), F.col("pos")).alias("stays"))
    dropped = found.select("template", _KEY, "pos").join(spots_of, ["template", _KEY])
    return dropped.filter(F.col("stays").isNull() | (F.col("pos") != F.col("stays"))).select(_KEY, "pos")


def _deduped(docs: DataFrame, settings: dict) -> DataFrame:
    """row, before, text, n_lines, n_dropped: every row of ``docs`` whole, its text and what stays of it."""
    dropped = recurring_lines(docs, **settings).groupBy(_KEY).agg(F.array_sort(F.collect_set("pos")).alias("drop"))
    packed = docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"), F.col("text").alias("before"), *_identity(docs)).join(dropped, _KEY, "left")
    # only texts that lose a line are taken apart
    packed = packed.withColumn("lines", F.when(F.col("drop").isNotNull(), F.split("before", "\n")))
    # the runs between dropped lines, put together again: linear in the length of a text
    kept = F.expr(
        "array_join(flatten(transform(sequence(0, size(drop)), j -> slice(lines, if(j = 0, 0, drop[j - 1] + 1) + 1, "
        "if(j = size(drop), size(lines), drop[j]) - if(j = 0, 0, drop[j - 1] + 1)))), '\n')"
    )
    return packed.select(
        "row",
        F.when(F.col("drop").isNull(), F.col("before")).otherwise(kept).alias("text"),
        F.coalesce(F.length("before") - F.length(F.replace("before", F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_dropped"),
    )


def dedup_lines(docs: DataFrame, **settings) -> DataFrame:
    """``docs`` without recurring lines in ``text``; ``n_chars`` is renewed if there is one."""
    changed = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return _deduped(docs, settings).select(*((changed[c] if c in changed else F.col("row").getField(c)).alias(c) for c in docs.columns))


def line_digest(docs: DataFrame, **settings) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_chars, kept_md5 (null for a null text)."""
    out = _deduped(docs.select("doc_id", "text"), settings)
    return out.select("row.doc_id", "n_lines", "n_dropped", F.length("text").cast("long").alias("kept_chars"), F.md5(F.col("text").cast("binary")).alias("kept_md5"))


DIGEST_SQL = f"""
WITH raw AS (
  SELECT d.doc_id, t.i - 1 AS pos, d.ls[t.i] AS l
  FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL) d, unnest(range(1, len(d.ls) + 1)) AS t(i)
), masked AS (
  SELECT doc_id, pos, regexp_replace(trim(regexp_replace(l, '[ \t\v\f\r]+', ' ', 'g')), '[^ ]*[0-9][^ ]*', '<*>', 'g') AS line FROM raw
), cut AS (
  SELECT *, string_split(line, ' ') AS w FROM masked
), spots AS (
  SELECT *, len(w) || ' ' || array_to_string(w[1:{DEPTH}], ' ') AS leaf FROM cut
), frequency AS (
  SELECT t.i AS place, w[t.i] AS word, count(*) AS lines FROM spots, unnest(range(1, least(len(w), {DEPTH}) + 1)) AS t(i) GROUP BY ALL
), chance AS (
  SELECT leaf, log2(n) - sum(log2(n / lines)) * any_value(len(w)) / least(any_value(len(w)), {DEPTH}) AS chance
  FROM (SELECT leaf, any_value(w) AS w FROM spots GROUP BY leaf) l, (SELECT count(*)::DOUBLE AS n FROM spots) a, unnest(range(1, least(len(w), {DEPTH}) + 1)) AS t(i)
  JOIN frequency ON place = t.i AND word = w[t.i] GROUP BY leaf, n
), lines AS (
  SELECT leaf, line, w, count(DISTINCT doc_id) AS docs FROM spots GROUP BY ALL
), words AS (
  SELECT leaf, line, docs, t.i AS place, w[t.i] AS word FROM lines, unnest(range(1, len(w) + 1)) AS t(i)
), fixed AS (
  SELECT leaf, place, word, sum(docs) AS n FROM words GROUP BY ALL HAVING sum(docs) >= 2
), usual AS (
  SELECT leaf, place, word AS usual FROM fixed QUALIFY row_number() OVER (PARTITION BY leaf, place ORDER BY n DESC, word) = 1
), templates AS (
  SELECT words.leaf, line, string_agg(CASE WHEN fixed.n IS NOT NULL THEN word ELSE coalesce(usual, '<*>') END, ' ' ORDER BY place) AS template
  FROM words LEFT JOIN fixed USING (leaf, place, word) LEFT JOIN usual USING (leaf, place)
  GROUP BY words.leaf, line HAVING count(fixed.n) >= {SIMILARITY} * count(*)
), found AS (
  SELECT doc_id, pos, leaf, template, len(w) AS k FROM spots JOIN templates USING (leaf, line)
), in_docs AS (
  SELECT leaf, template, k, doc_id, min(pos) AS pos FROM found GROUP BY ALL
), held AS (
  SELECT *, min(doc_id) OVER (PARTITION BY leaf, template) AS first_id FROM in_docs QUALIFY count(*) OVER (PARTITION BY leaf, template) >= 2
), borrowed AS (
  SELECT doc_id, sum(k) AS borrowed FROM held WHERE doc_id <> first_id GROUP BY doc_id
), own AS (
  SELECT doc_id, sum(len(w)) - coalesce(any_value(borrowed), 0) AS own FROM spots LEFT JOIN borrowed USING (doc_id) GROUP BY doc_id
), copies AS (
  SELECT h.first_id, h.doc_id FROM held h JOIN own x ON x.doc_id = h.doc_id JOIN own y ON y.doc_id = h.first_id WHERE h.doc_id <> h.first_id
  GROUP BY h.first_id, h.doc_id HAVING sum(k) >= {COPY}::DOUBLE * (any_value(x.own) + any_value(y.own))
), told AS (
  SELECT held.*, held.doc_id = held.first_id OR copies.doc_id IS NOT NULL AS alike FROM held LEFT JOIN copies ON copies.first_id = held.first_id AND copies.doc_id = held.doc_id
), counted AS (
  SELECT leaf, template, count(*) FILTER (WHERE NOT alike)::DOUBLE AS m, any_value(chance) AS chance, pow(2.0::DOUBLE, any_value(chance)) AS expected FROM told JOIN chance USING (leaf) GROUP BY leaf, template
), recurring AS (
  SELECT leaf, template FROM counted WHERE m > 0 AND m > expected AND m * (log2(m) - chance) - (m - expected) * log2(exp(1.0::DOUBLE)) >= {EVIDENCE}
), dropped AS (
  SELECT DISTINCT f.doc_id, f.pos FROM found f JOIN recurring USING (leaf, template) JOIN told t ON t.leaf = f.leaf AND t.template = f.template AND t.doc_id = f.doc_id WHERE NOT (t.alike AND t.pos = f.pos)
), kept AS (
  SELECT doc_id, count(*) AS n_lines, count(dropped.pos) AS n_dropped,
    coalesce(string_agg(l, chr(10) ORDER BY pos) FILTER (WHERE dropped.pos IS NULL), '') AS text
  FROM raw LEFT JOIN dropped USING (doc_id, pos) GROUP BY doc_id
)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped, length(kept.text) AS kept_chars, md5(kept.text) AS kept_md5
FROM documents LEFT JOIN kept USING (doc_id)
"""

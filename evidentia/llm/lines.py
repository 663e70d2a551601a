"""Line dedup by a log-template tree of fixed depth.

A line's digits are masked and it is cut into words. The tree's first level is the word count, the
next DEPTH levels are the leading words; a line's path ends in a leaf. In leaves that lines of at
least ``min_docs`` documents reach, fields are generalised. A word's support is the number of (line,
document) occurrences of the leaf that have it at its place. A line's level is the support that
``similarity`` of its words reach; below ``min_docs`` it has no template. A word stays constant where
its support is at least ``min_docs`` and ``share`` of the line's level, and is a variable field
elsewhere: a field of many values stays variable as the corpus grows, and a rare template beside a
frequent one in its leaf goes by its own level. Constants make the line's template. A template found
in at least ``min_docs`` documents recurs: its lines are dropped, but for its first occurrence
(smallest id, then line), so that a group of copies keeps one whole text.

With ``exact_docs``, a line also recurs where it stands unchanged (but for masked digits and spaces) in
at least that many documents. Lines of fewer than ``min_words`` words have no template; they recur by
that rule alone, and their digits are not masked, since too little would be left. Without it they stay.

Everything is a group by with partial sums or an equality join on hashed paths, so no leaf's lines
ever meet in one task. Lines, words and templates are told apart by two independent 64-bit hashes each,
since text is deleted on their word: at 10^12 lines one pair of hashes is expected to clash with a chance
under 10^-14. The two joins with texts are sort-merge joins at every size: their other sides
grow with the input and are never broadcast. Null and empty texts
have no lines to drop and stay as they are. Rows that share an id count as one document and lose the
same lines; rows whose id is null keep everything. Extra columns pass through unread; where one is called
``n_lines`` or ``n_dropped``, the operator's own column of that name has underscores appended.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import stored, unused

DEPTH = 3
MIN_WORDS = 5
MIN_DOCS = 3
EXACT_DOCS = 2
SIMILARITY = 0.75
SHARE = 0.25


def _split(line: str) -> str:
    """SQL: words of a line."""
    return f"filter(split({line}, '[ \\\\t\\\\r\\\\f\\\\x0B]+'), w -> w <> '')"


def _words(line: str) -> str:
    """SQL: masked words of a line."""
    return _split(f"regexp_replace({line}, '[0-9]+', '<*>')")


def _twice(*of: Column) -> Column:
    """Two independent hashes of the same columns."""
    return F.struct(F.xxhash64(*of).alias("a"), F.xxhash64(F.lit("second"), *of).alias("b"))


def _lines(docs: DataFrame, min_words: int, short: bool) -> DataFrame:
    """(doc_id, line_no, leaf, line, long): hashes of the path and of the masked line; a short line's path is its words as they stand."""
    each = docs.where("doc_id is not null and text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    each = each.select("doc_id", "line_no", "line", F.expr(_words("line")).alias("w")).where(F.size("w") >= (1 if short else min_words))
    path = F.xxhash64(F.size("w"), *[F.col("w")[i] for i in range(min(DEPTH, min_words))])
    if not short:
        return each.select("doc_id", "line_no", path.alias("leaf"), _twice(F.col("w")).alias("line"), F.lit(True).alias("long"))
    own = F.when(F.size("w") >= min_words, F.col("w")).otherwise(F.expr(_split("line")))
    each = each.select("doc_id", "line_no", "w", (F.size("w") >= min_words).alias("long"), own.alias("own")).select("doc_id", "line_no", "w", "long", _twice(F.col("own")).alias("line"))
    return each.select("doc_id", "line_no", F.when(F.col("long"), path).otherwise(F.col("line.a")).alias("leaf"), "line", "long")


def recurring(docs: DataFrame, min_docs: int = MIN_DOCS, min_words: int = MIN_WORDS, similarity: float = SIMILARITY, share: float = SHARE, exact_docs: int | None = None) -> DataFrame:
    """(doc_id, line_no): lines to drop; a line may come twice. docs: doc_id, text."""
    lines = stored(_lines(docs, min_words, exact_docs is not None), "lines")
    # what is joined with hot leaves is stored first, so that both sides are dealt out for the join alone and a hot key's rows can be split
    leaves = lines.groupBy("leaf", "doc_id").agg(F.max("long").alias("long")).groupBy("leaf").agg(F.count("*").alias("count"), F.max("long").alias("long"))
    leaves = leaves.where(F.col("count") >= min(min_docs, exact_docs or min_docs))
    leaves = stored(leaves.select("leaf", (F.col("long") & (F.col("count") >= min_docs)).alias("wide")), "leaves")
    lines = stored(lines.drop("long").join(leaves, "leaf"), "leaf-lines")
    first = F.min(F.struct("doc_id", "line_no"))
    distinct = lines.groupBy("leaf", "line", "doc_id").agg(F.min("line_no").alias("line_no"), F.max("wide").alias("wide")).groupBy("leaf", "line").agg(F.count("*").alias("n"), first.alias("rep"), F.max("wide").alias("wide"))
    distinct = stored(distinct.select("leaf", "line", "n", "wide", "rep.*"), "distinct-lines")
    # the words of one line each, from its representative document
    wanted = distinct.where("wide").groupBy("doc_id").agg(F.collect_list(F.struct("line_no", "leaf", "line", "n")).alias("wanted"))
    text = docs.where("doc_id is not null and text is not null").select("doc_id", "text").join(wanted.hint("merge"), "doc_id").select(F.split("text", "\n").alias("all"), F.explode("wanted").alias("x"))
    words = text.select("x.leaf", "x.line", "x.n", F.expr(_words("element_at(all, x.line_no + 1)")).alias("w"))
    words = words.where(F.xxhash64("w") == F.col("line.a"))  # rows that share an id may differ in text
    words = stored(words.select("leaf", "line", "n", F.size("w").alias("size"), F.posexplode("w").alias("at", "w")).select("leaf", "line", "n", "size", _twice(F.col("at"), F.col("w")).alias("word")).distinct(), "words")
    constant = words.groupBy("leaf", "word").agg(F.sum("n").alias("support")).where(F.col("support") >= min_docs)
    # a line's supported words from the most frequent on; the last of those it needs has the line's level
    template = words.join(constant, ["leaf", "word"]).groupBy("leaf", "line").agg(F.sort_array(F.collect_list(F.struct("support", "word")), asc=False).alias("held"), F.max("size").alias("size"))
    template = template.where(F.size("held") >= F.col("size") * similarity).withColumn("least", F.element_at("held", F.ceil(F.col("size") * similarity).cast("int"))["support"] * share)
    template = stored(template.select("leaf", "line", _twice(F.expr("transform(filter(held, h -> h.support >= least), h -> h.word)")).alias("template")), "templates")
    found = stored(lines.where("wide").join(template, ["leaf", "line"]).select("leaf", "template", "doc_id", "line_no"), "templated")
    common = found.groupBy("leaf", "template", "doc_id").agg(F.min("line_no").alias("line_no")).groupBy("leaf", "template").agg(F.count("*").alias("docs"), first.alias("first"))
    common = stored(common.where(F.col("docs") >= min_docs).select("leaf", "template", F.col("first.doc_id").alias("first_doc"), F.col("first.line_no").alias("first_line")), "common")
    later = F.expr("not (doc_id = first_doc and line_no = first_line)")
    drop = found.join(common, ["leaf", "template"]).where(later).select("doc_id", "line_no")
    if exact_docs is None:
        return drop
    exact = distinct.where(F.col("n") >= exact_docs).select("leaf", "line", F.col("doc_id").alias("first_doc"), F.col("line_no").alias("first_line"))
    return drop.unionByName(lines.join(stored(exact, "exact"), ["leaf", "line"]).where(later).select("doc_id", "line_no"))


def _kept(text: str, drop: str) -> Column:
    return F.expr(f"array_join(filter(transform(split({text}, '\\n'), (l, i) -> if(array_contains({drop}, i), null, l)), l -> l is not null), '\\n')")


def counted(columns: list[str]) -> tuple[str, str]:
    """Names of the columns that ``dedup`` adds to a table of these columns."""
    return unused(columns, "n_lines"), unused(columns, "n_dropped")


def dedup(docs: DataFrame, text: str = "text", key: str = "doc_id", **params) -> DataFrame:
    """The columns of docs, with recurring lines taken out of the text, and n_lines and n_dropped (long)."""
    own = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    doc, gone, n, dropped = (unused(docs.columns, x) for x in ("__doc", "__drop", "__n", "__gone"))
    drop = recurring(own, **params).groupBy(F.col("doc_id").alias(doc)).agg(F.array_sort(F.collect_set("line_no")).alias(gone))
    joined = docs.join(drop.hint("merge"), F.col(f"`{key}`").cast("long") == F.col(doc), "left")
    source = F.col(f"`{text}`")
    lines = F.when(source.isNull(), 0).otherwise(F.size(F.split(source, "\n")))
    # counted ahead of the new text, whose name must not be taken for the old one's
    joined = joined.withColumn(n, lines).withColumn(dropped, F.coalesce(F.size(F.filter(gone, lambda i: i < F.col(n))), F.lit(0)))
    joined = joined.withColumn(dropped, F.when(F.col(gone).isNull(), 0).otherwise(F.col(dropped)))
    new = F.when(F.col(gone).isNull(), source.cast("string")).otherwise(_kept(f"`{text}`", gone))
    n_lines, n_dropped = counted(docs.columns)
    return joined.select(*[new.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns], F.col(n).cast("long").alias(n_lines), F.col(dropped).cast("long").alias(n_dropped))

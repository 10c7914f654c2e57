"""Near-duplicate lines by a segment-partition edit join.

Lines within `threshold` edits of each other: when the shorter one is cut into threshold + 1
segments, one of them occurs unchanged in the longer one, near its own place. The index lists lines
under (length, segment number, segment); a line probes the index of its own length and of shorter
ones with its substrings at the few places an alignment allows. Candidates are verified by the
banded edit distance that Spark offers, which stops beyond the threshold.

A list that very many lines share is not paired. With one edit allowed, the half that is not shared
then differs by at most one edit, which means that both lines have a form of it with at most one
character left out in common; so members name those forms and meet only where they are links.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from logloom.llm.registry import query, table
from logloom.session import hint_small, settled, stored, unused

THRESHOLD = 1  # edits
MIN_CHARS = 20  # shorter lines are compared for equality only
MIN_COUNT = 2  # occurrences that make a line a repeated one
LIST_LIMIT = 100  # members of a list that is paired directly


def known_by(text: Column) -> Column:
    """What a text is known by: a 128-bit hash; null for none."""
    return F.unhex(F.md5(text))


def _with_lines(docs: DataFrame, id: str, text: str) -> DataFrame:
    """One row per line with a word: id, doc (hash of the text), at (line number), line, a, b (its identity)."""
    rows = docs.select(F.col(id).alias("id"), known_by(F.col(text)).alias("doc"), F.posexplode(F.split(F.col(text), "\n")).alias("at", "line"))
    worded = rows.filter(F.col("line").rlike("[^ \\t-\\r]"))
    return worded.withColumns({"a": F.xxhash64("line"), "b": F.xxhash64(F.lit(1), "line")})


def _segments(length: Column, count: int) -> list[tuple[Column, Column]]:
    """(start, size) of each of `count` nearly equal segments of a line, longer ones last."""
    short = F.floor(length / count).cast("int")
    longer = (length % count).cast("int")
    out = []
    for k in range(count):
        extra_before = F.greatest(F.lit(0), F.lit(k) - (F.lit(count) - longer))
        size = short + F.when(F.lit(k) >= F.lit(count) - longer, 1).otherwise(0)
        out.append((short * k + extra_before, size))
    return out


def _entries(threshold: int) -> tuple[Column, Column]:
    """Index keys of a line, and its probe keys, as arrays of longs."""
    count, size = threshold + 1, F.length("line")
    key = lambda n, k, start, width: F.xxhash64(n, F.lit(k), F.substring(F.col("line"), start + 1, width))
    index = F.array(*(key(size, k, start, width) for k, (start, width) in enumerate(_segments(size, count))))
    probes = []
    for gap in range(threshold + 1):  # the indexed line is shorter by `gap`
        shorter = size - gap
        for k, (start, width) in enumerate(_segments(shorter, count)):
            low, high = max(-k, gap - (threshold - k)), min(k, gap + threshold - k)
            probes += [key(shorter, k, start + shift, width) for shift in range(low, high + 1)]
    return index, F.array_distinct(F.array(*probes))


def _left_out(part: Column) -> Column:
    """Hashes of a string and of its forms with one character left out."""
    return F.concat(F.array(F.xxhash64(part)), F.transform(
        F.sequence(F.lit(1), F.greatest(F.length(part), F.lit(1))),
        lambda n: F.xxhash64(F.concat(F.substring(part, F.lit(1), n - 1), F.substring(part, n + 1, F.length(part)))),
    ))


def links(lines: DataFrame, threshold: int = THRESHOLD, min_chars: int = MIN_CHARS, list_limit: int = LIST_LIMIT) -> DataFrame:
    """(a, b, c, d): pairs of different lines (a, b) and (c, d) within `threshold` edits, each pair once."""
    long = lines.filter(F.length("line") >= max(min_chars, threshold + 1))
    index, probes = _entries(threshold)
    keyed = long.select("a", "b", F.length("line").alias("n"), index.alias("index"), probes.alias("probes"))
    entries = keyed.select("a", "b", "n", F.explode(F.concat(
        F.transform("index", lambda k: F.struct(k.alias("key"), F.lit(True).alias("own"))),
        F.transform("probes", lambda k: F.struct(k.alias("key"), F.lit(False).alias("own"))),
    )).alias("e")).select("a", "b", "n", "e.key", "e.own").distinct()
    entries = stored(entries, "segments")
    # Only lists with two lines can hold a link; a line's own segments are among its probes.
    sizes = entries.groupBy("key").agg(F.sum(F.col("own").cast("int")).alias("held"), F.sum((~F.col("own")).cast("int")).alias("asked"))
    sizes = sizes.filter("held > 0 and asked > 1").withColumn("long", F.col("held") + F.col("asked") > list_limit)
    met = stored(entries.join(sizes.select("key", "long"), "key"), "lists")
    paired = met.filter(~F.col("long")) if threshold == 1 else met
    own = paired.filter("own").select("key", "a", "b", "n")
    asked = paired.filter("not own").select("key", F.col("a").alias("c"), F.col("b").alias("d"), F.col("n").alias("m"))
    other = (F.col("n") < F.col("m")) | (F.struct("a", "b") < F.struct("c", "d"))
    pairs = own.join(asked, "key").filter((F.col("n") <= F.col("m")) & other).select("a", "b", "c", "d")
    if threshold == 1:
        pairs = pairs.unionByName(_meet(long, met.filter("long")))
    pairs = stored(pairs.distinct(), "pairs")
    needed = stored(pairs.select("a", "b").union(pairs.select("c", "d")).distinct(), "needed")
    texts = stored(long.select("a", "b", "line").join(hint_small(needed), ["a", "b"]).dropDuplicates(["a", "b"]), "texts")
    other_texts = texts.select(F.col("a").alias("c"), F.col("b").alias("d"), F.col("line").alias("other"))
    return (
        pairs.join(texts, ["a", "b"]).join(other_texts, ["c", "d"])
        .filter(F.levenshtein("line", "other", threshold) >= 0).select("a", "b", "c", "d").distinct()
    )


def _meet(long: DataFrame, crowded: DataFrame) -> DataFrame:
    """Pairs from lists too long to pair, for one edit."""
    members = stored(crowded.select("key", "a", "b").distinct(), "crowded")
    lines = long.select("a", "b", "line").join(hint_small(members.select("a", "b").distinct()), ["a", "b"]).dropDuplicates(["a", "b"])
    size = F.length("line")
    # For each length of the shorter line and each half: the half that is shared, and the other one.
    ways = []
    for gap in (0, 1):
        for k, (start, width) in enumerate(_segments(size - gap, 2)):
            at = start if k == 0 else start + gap
            rest = F.substring(F.col("line"), width + 1, size) if k == 0 else F.substring(F.col("line"), F.lit(1), at)
            ways.append(F.struct(F.xxhash64(size - gap, F.lit(k), F.substring(F.col("line"), at + 1, width)).alias("key"), rest.alias("rest")))
    forms = lines.select("a", "b", F.explode(F.array(*ways)).alias("way")).select("a", "b", "way.key", "way.rest").join(members, ["key", "a", "b"])
    forms = forms.select("a", "b", "key", F.explode(F.array_distinct(_left_out(F.col("rest")))).alias("form")).distinct()
    shared = forms.groupBy("key", "form").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    left = stored(forms.join(shared, ["key", "form"]), "forms")
    right = left.select("key", "form", F.col("a").alias("c"), F.col("b").alias("d"))
    return left.join(right, ["key", "form"]).filter(F.struct("a", "b") < F.struct("c", "d")).select("a", "b", "c", "d")


def repeated(docs: DataFrame, id: str = "doc_id", text: str = "text", threshold: int = THRESHOLD, min_chars: int = MIN_CHARS,
             min_count: int = MIN_COUNT, list_limit: int = LIST_LIMIT, groups: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The occurrences to remove (id, doc, at), and per line text (a, b, n_links).

    A line text that occurs at least `min_count` times keeps its first occurrence only. Of two linked
    texts that together occur so often, the one that comes first later goes altogether. Occurrences
    are ordered by id (null last), hash of the text, line number; equal rows share their fate.

    `groups`: (doc, grp), the group of copies of each text, by its hash. A group then counts
    a line as often as one of its documents holds it, and the documents of the group of the first
    occurrence keep the line, each once: copies stay copies.
    """
    lines = _with_lines(docs, id, text)
    seen = lines.drop("line")
    seen = stored(seen if groups is None else seen.join(hint_small(groups), "doc"), "lines")
    place = F.struct(F.col("id").isNull().alias("last"), "id", "doc", "at")
    if groups is None:
        classes = seen.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first"))
    else:
        once = stored(seen.groupBy("a", "b", "grp", "id", "doc").agg(F.countDistinct("at").alias("n"), F.min("at").alias("at")), "lines-of-documents")
        classes = once.groupBy("a", "b", "grp").agg(F.max("n").alias("n"), F.min(place).alias("first"))
        classes = classes.groupBy("a", "b").agg(F.sum("n").alias("n"), F.min(F.struct("first", "grp")).alias("f")).select("a", "b", "n", "f.first", "f.grp")
    classes = stored(classes, "line-classes")
    pairs = settled(lambda: links(lines.select("a", "b", "line"), threshold, min_chars, list_limit), "line-links")
    degree = pairs.select("a", "b").union(pairs.select("c", "d")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_links"))
    one = classes.select("a", "b", F.col("n").alias("n1"), F.col("first").alias("first1"))
    two = classes.select(F.col("a").alias("c"), F.col("b").alias("d"), F.col("n").alias("n2"), F.col("first").alias("first2"))
    if groups is not None:
        one, two = (side.join(classes.select(F.col("a").alias(x), F.col("b").alias(y), F.col("grp").alias(g)), [x, y]) for side, x, y, g in ((one, "a", "b", "grp1"), (two, "c", "d", "grp2")))
    both = pairs.join(one, ["a", "b"]).join(two, ["c", "d"]).filter(F.col("n1") + F.col("n2") >= min_count)
    held = seen.join(degree, ["a", "b"]).groupBy("id", "doc").agg(F.sum("n_links").alias("n_links"))
    if groups is not None:
        return _gone_in_groups(seen, once, classes, both, min_count), held
    late = F.when(F.col("first1") < F.col("first2"), F.struct(F.col("c").alias("a"), F.col("d").alias("b"))).otherwise(F.struct("a", "b"))
    late = both.select(late.alias("late")).select("late.a", "late.b").distinct().withColumn("late", F.lit(True))
    doomed = classes.join(late, ["a", "b"], "left").filter(F.coalesce("late", F.lit(False)) | (F.col("n") >= max(2, min_count)))
    gone = (
        seen.join(doomed.select("a", "b", "first", "late"), ["a", "b"])
        .filter(F.coalesce("late", F.lit(False)) | (place != F.col("first"))).select("id", "doc", "at")
    )
    return gone, held


def _gone_in_groups(seen: DataFrame, once: DataFrame, classes: DataFrame, both: DataFrame, min_count: int) -> DataFrame:
    """The occurrences to remove where the documents of a group are copies of each other."""
    # A text that comes later than a linked one goes from all groups but the earlier text's, and there from
    # the documents that hold the earlier text too.
    sides = lambda late, early, keep: F.struct(*(F.col(x).alias(y) for x, y in zip((*late, *early, keep), ("a", "b", "early_a", "early_b", "keep"))))
    later = F.when(F.col("first1") < F.col("first2"), sides("cd", "ab", "grp1")).otherwise(sides("ab", "cd", "grp2"))
    linked = stored(both.select(later.alias("late")).select("late.*"), "late-lines")
    late = linked.groupBy("a", "b").agg(F.min("keep").alias("least"), F.max("keep").alias("most"))
    often = classes.filter(F.col("n") >= max(2, min_count)).select("a", "b", F.col("grp").alias("keep"))
    elsewhere = (F.col("grp") != F.col("least")) | (F.col("grp") != F.col("most"))
    tops = once.withColumnRenamed("at", "top").withColumnsRenamed({c: f"_{c}" for c in ("a", "b", "grp", "id", "doc")})
    same = F.col("id").eqNullSafe(F.col("_id"))
    for c in ("a", "b", "grp", "doc"):
        same = same & (F.col(c) == F.col(f"_{c}"))
    again = seen.join(often, ["a", "b"]).join(tops, same)
    at_home = seen.join(linked, ["a", "b"]).filter(F.col("grp") == F.col("keep"))
    beside = at_home.join(tops.select("_a", "_b", "_grp", "_id", "_doc"), (
        (F.col("keep") == F.col("_grp")) & F.col("id").eqNullSafe(F.col("_id")) & (F.col("doc") == F.col("_doc")) & (F.col("early_a") == F.col("_a")) & (F.col("early_b") == F.col("_b"))
    ), "left_semi")
    return (
        again.filter((F.col("grp") != F.col("keep")) | (F.col("at") > F.col("top"))).select("id", "doc", "at")
        .unionByName(seen.join(late, ["a", "b"]).filter(elsewhere).select("id", "doc", "at"))
        .unionByName(beside.select("id", "doc", "at")).distinct()
    )


def _per_document(docs: DataFrame, removed: DataFrame, id: str, text: str) -> DataFrame:
    """Input rows with one more column, the numbers of the lines to remove, or null."""
    name, hash_ = unused(docs, "_id"), unused(docs, "_doc")
    match = docs[f"`{id}`"].eqNullSafe(F.col(name)) & (known_by(docs[f"`{text}`"]) == F.col(hash_))
    return docs.join(removed.select(F.col("id").alias(name), F.col("doc").alias(hash_), F.col("gone").alias(unused(docs, "_gone"))), match, "left").drop(name, hash_)


def dedup(docs: DataFrame, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The input rows, all columns, with repeated lines taken out of the text.

    Lines without a word are never repeated lines. A null text stays null; a text without repeated
    lines stays as it is, one that loses all its lines becomes empty. Of equal lines the first stays: the smallest
    id (null last), then the smallest hash of its text. Repeated rows share their fate; no rows give none.
    """
    # At most as many numbers as a text has lines.
    removed = lambda: repeated(docs, id, text, **options)[0].groupBy("id", "doc").agg(F.sort_array(F.collect_set("at")).alias("gone"))
    marked = _per_document(docs, settled(removed, "gone-lines"), id, text)
    gone = unused(docs, "_gone")
    kept = F.array_join(F.filter(F.split(F.col(text), "\n"), lambda _, at: ~F.array_contains(gone, at)), "\n")
    return marked.withColumn(text, F.when(F.col(gone).isNull(), F.col(text)).otherwise(kept)).drop(gone)


def judge(docs: DataFrame, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row per input row: id, n_lines (with a word), n_links (of its lines to different line texts),
    n_removed, removed (line numbers from 0, comma-joined). Nulls, ties and repeated rows as in `dedup`."""
    gone, held = repeated(docs, id, text, **options)
    size = F.size(F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda line: line.rlike("[^ \\t-\\r]")))
    rows = docs.select(F.col(id).alias("id"), known_by(F.col(text)).alias("doc"), size.cast("long").alias("n_lines"))
    removed = gone.groupBy("id", "doc").agg(F.sort_array(F.collect_set("at")).alias("gone"))
    out = rows
    for side in (removed, held):
        side = side.withColumnsRenamed({"id": "_id", "doc": "_doc"})
        out = out.join(side, F.col("id").eqNullSafe(F.col("_id")) & (F.col("doc") == F.col("_doc")), "left").drop("_id", "_doc")
    return out.select(
        F.col("id").alias(id), "n_lines", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce(F.array_join("gone", ","), F.lit("")).alias("removed"),
    )


@query("op6_line_dedup")
def op6_line_dedup(spark, folder):
    return judge(table(spark, folder, "documents"))

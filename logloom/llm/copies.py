"""Near-duplicate documents: sets of word shingles with a Jaccard similarity of `SIMILARITY` or more.

Equal sets fall together first. Two sets of the wanted similarity share one of their leading shingles
in any common order, if each leads with n - ceil(similarity * n) + 1 of its n shingles (prefix
filtering), so every such pair meets in a list of the index over leading shingles. The order puts
shingles last whose bit is set in a table filled from the frequent ones of a sample: what the table
holds changes the length of lists, never the result. Members of a list are compared with one of them,
then with another one; what is still in different components is compared pair by pair in lists of up to
`LIST_LIMIT` members, by its leading shingles and then its full sets.

Longer lists are not paired. Their members name how their sets differ from a centre, the shingles that more than half of
them hold; two sets differ from each other by what only one of them names. With d differences of a set of n shingles, two are
similar if d + d' - 2 * (shared differences) is at most (1 - similarity) / (1 + similarity) * (n + n'). Pairs that need no shared
difference are then linked through the member nearest to the centre, and the others meet in lists of leading differences,
the rarest first, which are lists like those before. All is exact up to 63-bit hash collisions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from logloom.llm.graph import components
from logloom.llm.words import WHITE
from logloom.session import hint_small, stored

WORDS = 5
SIMILARITY = 0.8
SAMPLE, FREQUENT = 16, 4  # one text of so many is sampled; a shingle in so many sampled texts is frequent
TABLE_BITS = 23  # the bit table has 2^23 bits, 1 MB
LIST_LIMIT = 100  # members of a list that is paired directly
DEPTH = 4  # lists of differences of differences beyond this are paired, however long
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
EPSILON = 1e-6


def _shingles(texts: DataFrame, words: int) -> DataFrame:
    """(node, grams) of (node, text): hashes of the shingles of lower-cased words, repeats included; a shorter text is one shingle."""
    lower = lambda w: F.when(F.octet_length(w) == F.length(w), F.lower(w)).otherwise(F.translate(w, UPPER, LOWER))
    split = F.array_remove(F.split(F.coalesce("text", F.lit("")), WHITE), "")
    coded = texts.select("node", F.transform(split, lambda w: F.xxhash64(lower(w))).alias("codes"))
    size = F.size("codes")
    side_by_side = F.arrays_zip(*(F.slice("codes", at + 1, F.greatest(size - words + 1, F.lit(0))) for at in range(words)))
    short = F.when(size > 0, F.array(F.xxhash64("codes"))).otherwise(F.array().cast("array<bigint>"))
    return coded.select("node", F.when(size >= words, F.transform(side_by_side, lambda s: F.xxhash64(s))).otherwise(short).alias("grams"))


def _least(n: Column, similarity: float) -> Column:
    return F.ceil(similarity * n - 1e-9)


def _near_sizes(similarity: float) -> Column:
    return F.least("na", "nb") >= _least(F.greatest("na", "nb"), similarity)


def _table(texts: DataFrame, words: int) -> DataFrame:
    """One row with the bits of frequent shingles, 64 to a number, by the last bits of their hashes."""
    sample = _shingles(texts.filter(F.pmod(F.xxhash64("node"), F.lit(SAMPLE)) == 0), words).select(F.explode(F.array_distinct("grams")).alias("gram"))
    frequent = sample.groupBy("gram").agg(F.count(F.lit(1)).alias("df")).filter(F.col("df") >= FREQUENT)
    cells = frequent.groupBy(_cell(F.col("gram")).alias("id")).agg(F.bit_or(F.expr("shiftleft(1L, cast(gram & 63 as int))")).alias("bits"))
    every = texts.sparkSession.range(1 << (TABLE_BITS - 6)).select(F.col("id").cast("int").alias("id")).join(F.broadcast(cells), "id", "left")
    return every.agg(F.sort_array(F.collect_list(F.struct("id", F.coalesce("bits", F.lit(0)).alias("bits"))))["bits"].alias("bits"))


def _cell(gram: Column) -> Column:
    return F.shiftright(gram.bitwiseAND(F.lit((1 << TABLE_BITS) - 1)), 6).cast("int")


def facts(docs: DataFrame, id: str, text: str = "text", words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """(node, same, n, lead) of every row: its id, a digest of its set, the set's size, its leading shingles. One
    pass reads the texts, and a sixteenth of them is read before it for the order of shingles."""
    texts = docs.select(F.col(id).alias("node"), F.col(text).alias("text"))
    top = F.lit(-(1 << 63))

    def marked(bits: Column, gram: Column) -> Column:
        # The first bit of a hash says whether it comes late: negative numbers are sorted before the others.
        late = F.getbit(F.get(bits, _cell(gram)), gram.bitwiseAND(F.lit(63)).cast("int")) == 1
        return F.when(late, gram.bitwiseAND(F.lit((1 << 63) - 1))).otherwise(gram.bitwiseOR(top))

    told = _shingles(texts, words).select("*", _table(texts, words).scalar().alias("bits"))
    ordered = F.transform(F.array("bits"), lambda b: F.transform("grams", lambda g: marked(b, g)))[0]
    sets = told.select("node", F.sort_array(F.array_distinct(ordered)).alias("grams")).withColumn("n", F.size("grams"))
    same = F.struct(F.xxhash64("grams").alias("a"), F.xxhash64(F.lit(1), "grams").alias("b"))
    return sets.select("node", same.alias("same"), "n", F.slice("grams", 1, (F.col("n") - _least(F.col("n"), similarity) + 1).cast("int")).alias("lead"))


def _open(lists: DataFrame, found: DataFrame) -> DataFrame:
    """`lists`: (key, node, ...). The rows of lists that still hold several components, with the component (root), the number of the
    list's members and the component with most of them (main)."""
    rooted = lists.join(components(found), "node", "left").withColumn("root", F.coalesce("root", "node"))
    held = rooted.groupBy("key", "root").agg(F.count(F.lit(1)).alias("members"))
    main = held.groupBy("key").agg(F.max_by("root", F.struct("members", "root")).alias("main"), F.sum("members").alias("members"), F.count(F.lit(1)).alias("roots"))
    return stored(rooted.join(main.filter("roots > 1").drop("roots"), "key"), "open")


def _crowds(crowded: DataFrame, similarity: float) -> DataFrame:
    """`crowded`: (key, node, n) of long lists. Returns (key, hub, node, n): the members, by classes of size, of the lists that
    one member stands for. Sets of the wanted similarity are of one class or of neighbouring ones."""
    own = F.floor(F.log(F.col("n").cast("double")) / math.log(1 / similarity) + 1e-9).cast("int")
    classed = crowded.select("key", "node", "n", F.explode(F.array(own, own + 1)).alias("class"), own.alias("own"))
    times = classed.groupBy("node").agg(F.count(F.lit(1)).alias("times"))
    first = F.max(F.struct("times", "node")).alias("first")
    hubs = classed.join(times, "node").groupBy("key", "class").agg(first, F.max(F.col("own") == F.col("class")).alias("needed"), F.count(F.lit(1)).alias("held"))
    hubs = stored(hubs.filter("needed and held > 1").select("key", "class", "first.node", "first.times"), "hubs")
    # Lists of much the same members have one hub, if each one's hub gives way to the first hub of the lists that it is in itself.
    theirs = hubs.select("key", "class", F.col("node").alias("_node"), F.col("times").alias("_times"))
    places = classed.join(hubs.select("node", "class").distinct(), ["node", "class"]).join(theirs, ["key", "class"])
    wider = places.groupBy("node", "class").agg(F.max(F.struct("_times", "_node"))["_node"].alias("hub"))
    named = hubs.join(wider, ["node", "class"]).select("key", "class", "hub")
    return classed.join(named, ["key", "class"]).select(F.xxhash64("hub", "class").alias("key"), "hub", "node", "n").distinct()


def _apart(members: DataFrame, sets: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """`members`: (key, hub, node, n), `sets`: (node, grams). Returns pairs of members with their key's centre that may need no shared
    difference, and lists (key, node, n, w, s) of leading differences; w and s say how many differences a pair has to share."""
    pace = (1 - similarity) / (1 + similarity)
    hub = hint_small(sets.join(members.select(F.col("hub").alias("node")).distinct(), "node", "left_semi")).select(F.col("node").alias("hub"), F.col("grams").alias("y"))
    both = members.join(sets.withColumnRenamed("grams", "x"), "node").join(hub, "hub")
    raw = stored(both.select("key", "node", F.explode(F.concat(F.array_except("x", "y"), F.array_except("y", "x"))).alias("gram")), "differences")
    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.max("n").alias("most"))
    counts = stored(raw.groupBy("key", "gram").agg(F.count(F.lit(1)).alias("held")).join(hint_small(sizes), "key"), "differences-held")
    common = hint_small(counts.filter(2 * F.col("held") > F.col("size")).select("key", "gram"))
    without = members.select("key", "node").join(common, "key").join(raw, ["key", "node", "gram"], "left_anti")
    centred = raw.join(common, ["key", "gram"], "left_anti").unionByName(without)
    rarity = counts.select("key", "gram", F.least("held", F.col("size") - F.col("held")).alias("held"))
    # A difference that no other member has cannot be shared.
    told = stored(centred.join(rarity, ["key", "gram"]).groupBy("key", "node").agg(
        F.count(F.lit(1)).alias("d"), F.sort_array(F.collect_list(F.when(F.col("held") > 1, F.struct("held", "gram")))).alias("named")), "centred")
    known = members.join(told, ["key", "node"], "left").select(
        "key", "node", "n", (F.coalesce("d", F.lit(0)) - pace * F.col("n")).alias("w"), F.greatest(F.coalesce(F.size("named"), F.lit(0)), F.lit(0)).alias("s"), "named")
    known = stored(known, "known")
    centre = known.groupBy("key").agg(F.min(F.struct("w", "node", "n")).alias("c"), F.max(2 * F.col("s") - F.col("w")).alias("reach"))
    known = known.join(hint_small(centre), "key").join(hint_small(sizes.select("key", "most")), "key")
    # Two sets are similar if they share (w + w') / 2 differences, and then both are similar to the centre's nearest one if that is 0 or less.
    stars = known.filter((F.col("w") + F.col("c.w") <= EPSILON) & (F.col("node") != F.col("c.node"))).select(
        F.col("c.node").alias("a"), F.col("c.n").alias("na"), F.col("node").alias("b"), F.col("n").alias("nb"))
    other = F.least(F.col("most"), F.col("n") / similarity + EPSILON)
    needed = F.greatest(F.lit(1), F.ceil((F.col("w") + F.col("c.w")) / 2 - EPSILON), F.ceil(F.col("w") - pace * other - EPSILON))
    leading = known.filter((F.col("w") <= F.col("reach") + EPSILON) & (needed <= F.col("s"))).select(
        "key", "node", "n", "w", "s", F.explode(F.slice("named", 1, (F.col("s") - needed + 1).cast("int"))["gram"]).alias("gram"))
    return stars, leading.select(F.xxhash64("key", "gram").alias("key"), "node", "n", "w", "s")


def links(texts: DataFrame, leads: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """`texts`: (node, text), `leads`: (node, n, lead) of texts with different sets. Returns (a, b), verified pairs
    whose connected components are those of all pairs at or above the similarity."""
    shared = leads.select(F.explode("lead").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    lists = stored(leads.select("node", "n", F.explode("lead").alias("key")).join(shared, "key"), "lists")
    leads = stored(lists.groupBy("node").agg(F.max("n").alias("n"), F.collect_set("key").alias("lead")), "leads")

    def sets_of(nodes: DataFrame) -> DataFrame:
        rows = texts.join(hint_small(nodes.select("node").distinct()), "node", "left_semi").dropDuplicates(["node"])
        return stored(_shingles(rows, words).select("node", F.array_distinct("grams").alias("grams")), "sets")

    def alike(pairs: DataFrame) -> DataFrame:
        # Sizes alone rule out most chance meetings.
        pairs = pairs.filter(_near_sizes(similarity)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        pairs = stored(pairs.distinct(), "pairs")
        # Common shingles that do not lead both sets come after the leading ones of one of them.
        one, two = leads.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("lead").alias("x")), leads.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("lead").alias("y"))
        others = _least(F.greatest("na", "nb"), similarity) - 1
        enough = (F.size(F.array_intersect("x", "y")) + others) * (1 + similarity) >= similarity * (F.col("na") + F.col("nb")) - EPSILON
        pairs = stored(pairs.join(one, "a").join(two, "b").filter(enough).select("a", "b"), "candidates")
        sets = sets_of(pairs.select(F.col("a").alias("node")).union(pairs.select("b")))
        one, two = sets.select(F.col("node").alias("a"), F.col("grams").alias("x")), sets.select(F.col("node").alias("b"), F.col("grams").alias("y"))
        both = F.size(F.array_intersect("x", "y"))
        return stored(pairs.join(one, "a").join(two, "b").filter(both >= _least(F.size("x") + F.size("y") - both, similarity)).select("a", "b"), "similar")

    member = lists.select("key", F.col("node").alias("b"), F.col("n").alias("nb"))
    hub = lists.groupBy("key").agg(F.min(F.struct("node", "n")).alias("hub"))
    found = alike(hub.join(member, "key").select(F.col("hub.node").alias("a"), F.col("hub.n").alias("na"), "b", "nb").filter("a <> b"))
    opened = _open(lists.filter("size > 2").drop("size"), found)
    if opened.isEmpty():
        return found
    member = opened.select("key", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("root").alias("other"))
    hub = opened.filter("root <> main").groupBy("key").agg(F.min(F.struct("node", "n", "root")).alias("hub"))
    found = found.union(alike(hub.join(member, "key").filter("hub.root <> other").select(F.col("hub.node").alias("a"), F.col("hub.n").alias("na"), "b", "nb")))
    held, sets = opened.select("key", "node", "n", F.lit(0.0).alias("w"), F.lit(0).alias("s")), None
    for depth in range(DEPTH + 1):
        opened = _open(held, found)
        if opened.isEmpty():
            break
        short = F.lit(depth == DEPTH) | (F.col("members") <= LIST_LIMIT)
        pairs, held = _pairs(opened.filter(short), similarity), None
        crowded = opened.filter(~short).select("key", "node", "n")
        if not crowded.isEmpty():
            if depth == 0:
                members = stored(_crowds(crowded, similarity), "crowds")
                sets = sets_of(members)
            else:
                members = crowded.join(crowded.groupBy("key").agg(F.min("node").alias("hub")), "key")
            stars, held = _apart(members, sets, similarity)
            pairs, held = pairs.unionByName(stars), stored(held, "lists")
        found = found.union(alike(pairs))
        if held is None:
            break
    return found


def _pairs(opened: DataFrame, similarity: float) -> DataFrame:
    """(a, na, b, nb): all pairs of members of a list that are in different components, nearly of one size, and have differences enough to share."""
    side = lambda x, root: opened.select("key", F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("w").alias(f"w{x}"), F.col("s").alias(f"s{x}"), F.col("root").alias(root), "main")
    enough = F.col("wa") + F.col("wb") <= 2 * F.least("sa", "sb") + EPSILON
    apart = (F.col("root") != F.col("other")) & ((F.col("other") == F.col("main")) | (F.col("a") < F.col("b")))
    return side("a", "root").filter("root <> main").join(side("b", "other").drop("main"), "key").filter(apart & _near_sizes(similarity) & enough).select("a", "na", "b", "nb")


def classes(docs: DataFrame, id: str, text: str = "text", words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """(id, component_id): per input row the smallest id reachable over similar pairs.

    Ids are of any type that sorts, and stay the same when `docs` is read again; rows with equal ids have equal texts. Null texts and texts without
    words are copies of each other. An empty table gives an empty result.
    """
    known = stored(facts(docs, id, text, words, similarity), "facts")
    first = stored(known.groupBy("same").agg(F.min(F.struct("node", "n", "lead")).alias("f")).select("same", "f.*"), "sets-firsts")
    joined = components(links(docs.select(F.col(id).alias("node"), F.col(text).alias("text")), first.filter("n > 0"), words, similarity))
    named = first.select("same", "node").join(joined, "node", "left").select("same", F.coalesce("root", "node").alias("component_id"))
    return known.select("node", "same").join(named, "same").select(F.col("node").alias(id), "component_id")

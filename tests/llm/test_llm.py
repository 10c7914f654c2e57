"""Operators of logloom.llm against brute force, and their edge cases."""

import collections
import hashlib
import itertools
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from logloom.llm import benchmarks, copies, lines, mixing, passages, pii, quality, simhash, suffixes, tokens, urls
from logloom.llm.graph import components
from logloom.llm.words import WORD

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, spans string, key string, hash long, row int"
RNG = random.Random(3)
VOCABULARY = ["".join(RNG.choice("abcdefgh") for _ in range(RNG.randint(2, 7))) for _ in range(400)]


def prose(n):
    return " ".join(RNG.choice(VOCABULARY) for _ in range(n))


PASSAGE = prose(60)
LINE = prose(12)
TEXTS = [
    None, "", " \n\t", "one", prose(120), prose(90) + " " + PASSAGE + " " + prose(20), PASSAGE + "\n" + prose(70),
    prose(40) + " " + PASSAGE[:-3] + "x" + prose(50), "aa " * 300, LINE + "\n" + prose(30) + "\n" + LINE, LINE + "x\n" + prose(30),
    "Él " + PASSAGE + " ñ\x0b\x0cé " + prose(10), "x" * 5000, prose(3000),
]
TEXTS += [TEXTS[4], TEXTS[4]]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i if i != 2 else None, t, "en" if i % 2 else None, [None, "a", "b"][i % 3], 1, "s", "k", 1, 1) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows + [rows[5]], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def all_texts():
    return [*TEXTS, TEXTS[5]]


def removed(units, window):
    counts = collections.Counter(tuple(u[i:i + window]) for u in units for i in range(len(u) - window + 1))
    out = []
    for u in units:
        gone = [False] * len(u)
        for i in range(len(u) - window + 1):
            if counts[tuple(u[i:i + window])] > 1:
                gone[i:i + window] = [True] * window
        out.append(gone)
    return out


def test_repeats_of_words_and_bytes(docs):
    split = [words(t) for t in all_texts()]
    want = collections.Counter(
        (len(w), sum(g), " ".join(x for x, y in zip(w, g) if not y)) for w, g in zip(split, removed(split, 35))
    )
    assert collections.Counter(tuple(r)[1:] for r in passages.without_repeats(docs).collect()) == want
    raw = [(t or "").encode() for t in all_texts()]
    want = collections.Counter(
        (len(b), sum(g), len(re.findall(b"\1+", bytes(g))), bytes(x for x, y in zip(b, g) if not y)) for b, g in zip(raw, removed(raw, 200))
    )
    for shard in (4096, 1):  # 1: every anchor with more than two contexts goes the way of extensions
        got = suffixes.without_repeats(docs, shard=shard).collect()
        assert collections.Counter((r[1], r[2], r[3], bytes(r[4])) for r in got) == want


def test_suffix_arrays_and_common_prefixes(monkeypatch):
    rng = np.random.default_rng(5)
    for trial in range(60):
        t = np.append(rng.integers(1, 1 + rng.integers(1, 5), rng.integers(1, 60)), 0) if trial else np.append(np.ones(50, dtype=int), 0)
        want = sorted(range(len(t)), key=lambda i: tuple(t[i:]))
        for wide in (1024, 1):
            monkeypatch.setattr(suffixes, "WIDE", wide)
            assert suffixes.suffix_array(t).tolist() == want
        shared = suffixes.common_prefixes(t, np.array(want), 16)
        for i, j in zip(want, want[1:]):
            same = next((n for n, (a, b) in enumerate(zip(t[i:], t[j:])) if a != b), min(len(t) - i, len(t) - j))
            assert shared[j] == min(same, 31)


def plain_print(text):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i:i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints(docs):
    got = collections.Counter(r.fp % (1 << 64) for r in simhash.near_duplicates(docs).collect())
    assert got == collections.Counter(map(plain_print, all_texts()))


@pytest.mark.parametrize("bits, limit", [(2, 64), (2, 2), (1, 64), (1, 2)])
def test_links_join_what_is_near(spark, bits, limit):
    rng = np.random.default_rng(bits)
    base = rng.integers(0, 1 << 63, 30)
    near = [int(b) ^ sum(1 << int(x) for x in rng.choice(63, rng.integers(1, 4), replace=False)) for b in base for _ in range(4)]
    prints = sorted({*map(int, base), *near})
    frame = spark.createDataFrame([(p,) for p in prints], "fp long")
    root = {r.node: r.root for r in components(simhash.links(frame, bits, limit)).collect()}
    mine = {p: p for p in prints}

    def find(x):
        while mine[x] != x:
            x = mine[x]
        return x

    for i, p in enumerate(prints):
        for q in prints[:i]:
            if (p ^ q).bit_count() <= bits:
                a, b = find(p), find(q)
                mine[max(a, b)] = min(a, b)
    assert {p: root.get(p, p) for p in prints} == {p: find(p) for p in prints}


def test_quality_counts(docs):
    def plain(text):
        w, found = words(text), collections.Counter()
        found.update(tuple(w[i:i + 3]) for i in range(len(w) - 2))
        covered = {i + j for i in range(len(w) - 2) for j in range(3) if found[tuple(w[i:i + 3])] > 1}
        full = [x for x in (text or "").split("\n") if words(x)]
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(full) - len(set(full)), len(covered)

    got = quality.judge(docs).collect()
    assert collections.Counter(tuple(r)[1:6] for r in got) == collections.Counter(plain(t) for t in all_texts())
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.kept and r.base_failed) for r in got)


def test_url_rules(spark):
    pages = [(1, "http://A.Example.org/es/x?q"), (2, "x://example.org/en/12#a"), (3, "http://example.org"), (4, None), (5, "no"), (5, "h://b.com/de/"),
             (None, "h://com/fr/"), (6, "h://notexample.org/es/1"), (6, "h://notexample.org/es/1")]
    rules = spark.createDataFrame(urls.RULES, "host string, path string, action string")
    for size in (100, 1):
        got = urls.judge(spark.createDataFrame(pages, "page_id long, url string"), rules, slice_rows=size).collect()
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, [
            (1, "a.example.org", "/es/x", "example.org/es/", "block"), (2, "example.org", "/en/12", "example.org/en/1", "block"),
            (3, "example.org", "", None, "allow"), (4, "", "", None, "allow"), (5, "", "", None, "allow"), (5, "b.com", "/de/", "com/de/", "block"),
            (None, "com", "/fr/", "com/fr/", "allow"), (6, "notexample.org", "/es/1", "org/", "allow"), (6, "notexample.org", "/es/1", "org/", "allow"),
        ]))


@pytest.mark.parametrize("block", [7, 4096])
def test_mix_reaches_its_targets(docs, block):
    got = mixing.mix(docs, block=block).collect()
    assert sorted(r.size for r in got) == sorted(len(words(t)) for t in all_texts())
    assert all(0 <= r.taken <= 2 * r.size for r in got)
    taken = collections.Counter()
    for r in got:
        taken[(r.source_size, r.target)] += r.taken
    assert all(t == int(target) for (_, target), t in taken.items())
    assert abs(sum(target for _, target in taken) - 1.5 * sum(size for size, _ in taken)) < 1e-6
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(5), block=block).collect()))


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("threshold, limit", [(1, 100), (1, 2), (2, 100)])
def test_line_links(spark, threshold, limit):
    rng = random.Random(threshold)
    texts = {prose(6)[:40] for _ in range(12)}
    for base in list(texts):
        for _ in range(5):
            text = base
            for _ in range(rng.randint(1, 2)):
                at = rng.randrange(len(text))
                text = rng.choice([text[:at] + text[at + 1:], text[:at] + "z" + text[at:], text[:at] + "q" + text[at + 1:]])
            texts.add(text)
    texts = sorted(texts)
    frame = spark.createDataFrame([(t,) for t in texts], "line string").select("line", F.xxhash64("line").alias("a"), F.xxhash64(F.lit(1), "line").alias("b"))
    name = {r.a: r.line for r in frame.collect()}
    got = {frozenset((name[r.a], name[r.c])) for r in lines.links(frame, threshold, 5, limit).collect()}
    assert got == {frozenset((x, y)) for i, x in enumerate(texts) for y in texts[:i] if edits(x, y) <= threshold}


def test_line_dedup(docs):
    kept = {r.doc_id: r.text for r in lines.dedup(docs).collect()}
    assert kept[9] == "\n".join(TEXTS[9].split("\n")[:2]) and kept[10] == TEXTS[10].split("\n")[1] and kept[0] is None and kept[1] == ""
    assert lines.dedup(docs).columns == docs.columns
    assert lines.judge(docs).count() == len(all_texts())


def test_pii_spans(spark):
    odd = ["1.2.3.4.5 +1 (23) 45-67.8 9 a@b.c_x@y.z", "😀 é a.b@c-d.e.f, 4111 1111 1111 1111", "999.1.1.1 0001.002.3.4", None, "", "x" * 3000 + "@" + "y." * 500 + "z", "1" * 5000]
    odd += [f"id no. {90000 + i}x and ip from 10.0.0.{i}" for i in range(9)] + ["ip from host-1234", "ip from host-1234"]
    found = {r.doc_id: r for r in pii.spans(spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string")).collect()}
    assert [[(s.kind, s.start, s.end) for s in found[i].base] for i in range(5)] == [
        [("ip", 0, 7), ("phone", 10, 27), ("email", 28, 33), ("email", 33, 39)], [("email", 4, 15), ("card", 17, 36)], [("ip", 10, 22)], [], [],
    ]
    assert [(s.kind, s.start, s.end) for s in found[16].extra] == [("id", 8, 17)] == [(s.kind, s.start, s.end) for s in found[17].extra]
    assert not found[7].extra or found[7].extra[0].kind == "id"


def test_decontamination(spark, docs):
    item = prose(30)
    edited = item.split()
    edited[5], edited[20] = "new", "word"
    rows = [(1, prose(50) + " " + item.upper() + "\n" + prose(5)), (2, prose(20) + " " + " ".join(edited)), (3, prose(200)), (4, None), (5, ""), (None, item), (1, item)]
    items = spark.createDataFrame([(7, item), (8, "a b c d"), (None, prose(20)), (9, None)], "item_id long, text string")
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(str((r.doc_id, r.item_id)) for r in benchmarks.contaminated(frame, items).collect()) == sorted(map(str, [(1, 7), (1, 7), (2, 7), (None, 7)]))
    assert sorted(r.doc_id for r in benchmarks.clean(frame, items).collect()) == [3, 4, 5]
    assert benchmarks.contaminated(docs, items.limit(0)).count() == 0
    assert benchmarks.align(np.array([1, 2, 3, 4]), np.array([9, 1, 2, 7, 4])) == 5 / 8


def test_token_histogram(docs):
    import public_tokenizers
    import tiktoken

    import base64
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(tokens.VOCABULARY, "rb"))}
    public = tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sizes = [len(public.encode_ordinary(t)) if t else 0 for t in all_texts()]
    rows = tokens.answers(tokens.histogram(tokens.lengths(docs))).collect()
    assert {r.n_tokens: r.n_docs for r in rows} == collections.Counter(sizes)
    for r in rows:
        assert (r.docs_from, r.tokens_from) == (sum(s >= r.n_tokens for s in sizes), sum(s for s in sizes if s >= r.n_tokens))
        assert r.truncated_tokens == sum(min(s, r.n_tokens) for s in sizes) and r.total_tokens == sum(sizes)
    (limit,) = tokens.under_limits(tokens.histogram(tokens.lengths(docs)), [50]).collect()
    assert (limit.docs_over, limit.truncated_tokens) == (sum(s > 50 for s in sizes), sum(min(s, 50) for s in sizes))


def test_empty_tables(spark, empty):
    items = spark.createDataFrame([], "item_id long, text string")
    rules = spark.createDataFrame(urls.RULES, "host string, path string, action string")
    for out in (passages.without_repeats(empty), suffixes.without_repeats(empty), simhash.near_duplicates(empty), quality.judge(empty), mixing.mix(empty),
                lines.judge(empty), lines.dedup(empty), pii.spans(empty), benchmarks.clean(empty, items), tokens.answers(tokens.histogram(tokens.lengths(empty))),
                urls.judge(spark.createDataFrame([], "page_id long, url string"), rules)):
        assert out.count() == 0


def test_pipeline_stages(spark, docs, tmp_path):
    from logloom.llm import pipeline

    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, PASSAGE)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = pipeline.run(spark, str(tmp_path)).collect()
    ids = sorted(r.doc_id for r in got)
    # 4 is kept once of three copies; texts with the benchmark passage, short and repetitive ones are gone;
    # 9 has 54 words, of which 24 repeat
    assert ids == [4, 9, 13] and len(words(TEXTS[4])) == next(r.size for r in got if r.doc_id == 4)
    assert re.fullmatch(WORD, "abc")


def test_row_numbers_outlive_other_splits(spark, tmp_path, monkeypatch):
    from logloom.llm import pipeline
    from logloom.session import stored

    good = [prose(80) for _ in range(24)]
    rows = [(i, good[i] if i % 3 else "short", "en", "s", 1) for i in range(24)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(8).write.parquet(str(tmp_path / "d"))
    name, judge = "spark.sql.files.openCostInBytes", quality.judge

    def judged(frame, **options):
        out = stored(judge(frame, **options), "judged")
        spark.conf.set(name, "1")  # later reads are split otherwise, as after a change in the number of cores
        return out

    monkeypatch.setattr(quality, "judge", judged)
    try:
        kept = pipeline.keep_good(spark, spark.read.parquet(str(tmp_path / "d")), "").collect()
    finally:
        spark.conf.unset(name)
    assert sorted(r.doc_id for r in kept) == [i for i in range(24) if i % 3]


def alike(a, b):
    return len(a & b) >= 0.8 * len(a | b) if a | b else True


def grouped(sets):
    """The smallest number of each set's component, by comparing all pairs."""
    mine = list(range(len(sets)))
    for i, x in enumerate(sets):
        for j in range(i):
            if mine[i] != mine[j] and alike(x, sets[j]):
                low, high = sorted((mine[i], mine[j]))
                mine = [low if m == high else m for m in mine]
    return mine


@pytest.mark.parametrize("frequent", [4, 1])
def test_edited_copies_are_found(spark, monkeypatch, frequent):
    monkeypatch.setattr(copies, "FREQUENT", frequent)
    monkeypatch.setattr(copies, "SAMPLE", 4 if frequent > 1 else 1)
    rng, texts = random.Random(9), [None, "", " ", "one two", "One  Two", prose(5)]
    shared = prose(30)
    for n in (20, 60, 150, 400):
        for _ in range(6):
            base = [prose(n) + " " + shared if rng.random() < 0.3 else prose(n)][0].split()
            texts.append(" ".join(base))
            for share in (0.005, 0.01, 0.02, 0.03, 0.04):
                texts.append(" ".join(w if rng.random() > share else "new%d" % rng.randrange(9) for w in base))
    base = prose(100).split()
    texts += [" ".join(base[:k] + ["x%d" % k] + base[k:]) for k in range(0, 100, 2)]  # a long list of copies, one edit each
    got = copies.classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), "doc_id").collect()
    split = [words((t or "").lower()) for t in texts]
    sets = [{tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in split]
    want = grouped(sets)
    assert {r.doc_id: r.component_id for r in got} == dict(enumerate(want))
    assert sum(m != i for i, m in enumerate(want)) > 100 and len(set(want)) > 30


def test_pipeline_drops_edited_copies(spark, tmp_path):
    from logloom.llm import pipeline

    base = prose(200).split()
    edited = base[:50] + ["new"] + base[51:120] + ["word"] + base[121:]
    rows = [(1, " ".join(base), "en", "s", 1), (2, " ".join(edited), "en", "s", 1), (3, prose(200), "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "d"))
    assert sorted(r.doc_id for r in pipeline.drop_copies(spark, spark.read.parquet(str(tmp_path / "d")), "").collect()) == [1, 3]


def test_pipeline_drops_rare_repeated_lines(spark, tmp_path):
    from logloom.llm import pipeline

    a, b, c, once, twice = ([prose(15) for _ in range(8)], [prose(15) for _ in range(8)], [prose(15) for _ in range(8)], prose(14), prose(14))
    texts = [a[:3] + [twice] + a[3:], b[:4] + [twice] + b[4:], c[:2] + [once] + c[2:5] + [once] + c[5:], a[:3] + [twice] + a[3:]]
    texts += [a[:3] + [twice] + a[3:6] + [a[6] + " new word"] + a[7:], [twice[:-1] + "Q"] + [prose(40)]]
    near = prose(13)
    texts += [[near, prose(40), near[:-1] + "Q"]]
    rows = [(i, "\n".join(t), "en", "s", 1) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "d"))
    got = {r.doc_id: r.text.split("\n") for r in pipeline.drop_lines(spark, spark.read.parquet(str(tmp_path / "d")), "").collect()}
    # The line of two groups stays in all copies of its first document; the one repeated inside stays once.
    assert got[0] == texts[0] and got[1] == b and got[2] == c[:2] + [once] + c[2:]
    assert got[3] == texts[3] and got[4] == texts[4] and got[5] == texts[5][1:] and got[6] == texts[6][:2]


@pytest.mark.parametrize("every", [5, 4])
@pytest.mark.parametrize("beside", [False, True])
def test_paraphrased_items_are_found(spark, every, beside):
    rng = random.Random(every)
    items = [prose(n) for n in (24, 40, 90)]
    changed = [" ".join("new%d" % i if i % every == every - 1 else w for i, w in enumerate(t.split())) for t in items]
    drawn = [" ".join(w if rng.random() > 1 / every else "some" for w in t.split()) for t in items]
    rows = [(i, prose(60) + " " + t + " " + prose(40)) for i, t in enumerate(changed + drawn)] + [(90, prose(300))]
    if beside:
        rows += [(100 + i, prose(20) + " " + t) for i, t in enumerate(items * 2)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    tests = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in benchmarks.contaminated(frame, tests).collect()}
    # every pair whose words align well enough, by aligning all with all
    want = {(d, i) for d, t in rows for i, item in enumerate(items) if benchmarks.align(benchmarks.lowered_words(item), benchmarks.lowered_words(t)) >= 0.5}
    assert got == want and {(i, i) for i in range(3)} <= got and (90, 0) not in got


def test_short_items_must_stand_whole(spark):
    items = ["one", "two Words", "a b c d", "p q r s t u v", "w x y z w x y z", "", None]
    texts = ["x one y", "ones", "two words", "two the words", "Z a b c d", "a b c x d", "p q r s t u v", "p q r s t u", "w x y z w x y q", None, ""]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    tests = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in benchmarks.contaminated(frame, tests).collect()}
    assert got == {(0, 0), (2, 1), (4, 2), (6, 3), (8, 4)}


def test_secrets_of_unseen_kinds_are_found(spark):
    rng, rows, planted = random.Random(21), [], set()
    for i in range(300):
        kind, body = i % 6, prose(30).split()
        token = None
        if kind == 0:
            token, shown = "".join(rng.choice("0123456789abcdef") for _ in range(20)), "password={}"
        elif kind == 1:
            token, shown = "AKIA" + "".join(rng.choice("ABCDEFGHIJKLMNOP234567") for _ in range(16)), "{}"
        elif kind == 2:
            token, shown = "".join(rng.choice("0123456789abcdef") for _ in range(40)), 'token = "{}"'
        elif kind == 3:
            token, shown = "usr_" + "".join(rng.choice("0123456789ABCDEF") for _ in range(14)), "{}"
        elif kind == 4:
            shown, token = "bob%d@mail.example.com" % i, ""
        if token is not None:
            body.insert(rng.randrange(5, 25), shown.format(token))
        rows.append((i, " ".join(body)))
        if token and any(c.isdigit() for c in token):
            planted.add((i, rows[-1][1].index(token), rows[-1][1].index(token) + len(token)))
    got = pii.spans(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    found = {(r.doc_id, s["start"], s["end"]) for r in got for s in r.extra}
    assert len(found & planted) >= 0.95 * len(planted) and found <= planted


@pytest.mark.parametrize("block", [4096, 50])
def test_mix_against_a_plain_schedule(docs, block):
    rows = [(r.doc_id, len(words(r.text)), r.source) for r in docs.collect()]
    size = collections.Counter()
    for _, n, s in rows:
        size[s] += n
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = dict(zip(names, itertools.cycle((3.0, 1.0, 2.0))))
    target, budget, open_ = {}, 1.5 * sum(size.values()), set(names)
    while open_:  # sources above their cap get it, the others share what is left
        level = (budget - sum(target.values())) / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * size[s]}
        target |= {s: 2.0 * size[s] for s in full} or {s: level * weight[s] for s in open_}
        open_ = open_ - full if full else set()
    got = collections.defaultdict(list)
    for r in mixing.mix(docs, block=block).collect():
        got[r.source_size, round(r.target, 6)].append(r)
    assert {k: sum(r.taken for r in v) for k, v in got.items()} == {(size[s], round(t, 6)): int(t) for s, t in target.items()}
    held = [r.asDict() for r in mixing.pieces(docs, block=block).collect()]
    # Slot by slot the point says the source; slots past the plan are the blocks that the points left.
    quota = {s: -(-int(target[s]) // block) for s in names if target[s] >= 1}
    total, edge, spans = sum(quota.values()), 0, []
    for s in names:
        if s in quota:
            spans.append((edge * mixing.UNIT // total, s))
            edge += quota[s]
    for p in held:
        if p["slot"] < total:
            point = p["slot"] * mixing.STEP % mixing.UNIT
            assert p["source"] == [s for low, s in spans if low <= point][-1]
    taken = collections.Counter()
    for p in held:
        taken[p["slot"], p["source"]] += p["words"]
    assert max(taken.values()) <= block and sum(taken.values()) == sum(int(t) for t in target.values())
    parts = collections.defaultdict(list)
    for p in held:
        parts[p["source"], p["offset"], p["pass"]].append((p["start"], p["words"]))
    for some in parts.values():  # what a pass takes of a document is a prefix of it, in pieces side by side
        at = 0
        for start, n in sorted(some):
            assert start == at
            at += n


def test_pipeline_drops_what_fingerprints_link(spark, tmp_path):
    from logloom.llm import pipeline

    body = prose(3) + " "
    texts = [body * 200 + prose(12), body * 200 + prose(12), prose(200)]
    assert simhash.fingerprint(texts[0]) == simhash.fingerprint(texts[1])  # their sets of shingles have little in common
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "d"))
    assert sorted(r.doc_id for r in pipeline.drop_copies(spark, spark.read.parquet(str(tmp_path / "d")), "").collect()) == [0, 2]


def test_copies_of_a_long_list_are_not_paired(spark, monkeypatch):
    base, rng, texts = prose(150).split(), random.Random(4), []
    for n in (2, 2, 2, 3, 4) * 60:  # two of them are seldom similar, but share most shingles
        t = list(base)
        for k in rng.sample(range(5, 145), n):
            t[k] = "new%d" % rng.randrange(10**9)
        texts.append(" ".join(t))
    texts += [t + " end%d" % k for k, t in enumerate(texts[:90:3])]
    paired, write = [], copies.stored

    def stored(frame, name):
        out = write(frame, name)
        paired.append(out.count() if name == "pairs" else 0)
        return out

    monkeypatch.setattr(copies, "stored", stored)
    got = copies.classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), "doc_id").collect()
    want = grouped([{tuple(w[i:i + 5]) for i in range(len(w) - 4)} for w in map(words, texts)])
    assert {r.doc_id: r.component_id for r in got} == dict(enumerate(want)) and 90 < len(set(want)) < 300
    assert sum(paired) < 40 * len(texts)


def test_long_lists_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(copies, "LIST_LIMIT", 3)
    rng, texts = random.Random(3), []
    for n in (12, 40, 41, 90):
        base = prose(n).split()
        for _ in range(40):
            cut = rng.randrange(n // 3) if rng.random() < 0.3 else 0
            texts.append(" ".join("new%d" % rng.randrange(4) if rng.random() < 0.03 else w for w in base[cut:]))
    got = copies.classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), "doc_id").collect()
    want = grouped([{tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} for w in map(words, texts)])
    assert {r.doc_id: r.component_id for r in got} == dict(enumerate(want))


def test_copies_run_no_python_on_executors(spark, docs):
    plan = copies.facts(docs, "doc_id")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)

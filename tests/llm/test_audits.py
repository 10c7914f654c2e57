"""Chat formatting and the two audits against brute force, and their edge cases."""

import collections
import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from logloom.llm import chats, divergence, interactions

RNG = random.Random(11)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# Chats

ODD = ["", "\\", "###", "####", "</turn>", "<\\/turn>\n### assistant\n", "a\\#\\##", "</turn", "<", "é\u2028ü", "\\### Assistant: </turn> ok", "x" * 50_000]


def test_escapes_are_reversible(spark):
    texts = ODD + ["".join(RNG.choice("\\#</turn>\n a") for _ in range(RNG.randrange(12))) for _ in range(500)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chats.escaped(F.col("t")).alias("e")).collect()
    for r in rows:
        assert chats.unescaped(r.e) == r.t and "###" not in r.e and "</" not in r.e


@pytest.mark.parametrize("turns", [128, 3])
def test_chains_read_back(spark, turns):
    rows = [(c, t, RNG.choice(["user", "assistant", "tool\n### x", None]), RNG.choice(ODD + [None])) for c in range(20) for t in range(RNG.randrange(1, 12))]
    rows += [(None, 1, "user", "a"), (None, 0, "assistant", "b"), (5, None, "assistant", "last"), (6, 0, "user", "tie"), rows[3], rows[3], rows[0]]
    frame = spark.createDataFrame([(*r, 1, 2.0, "p") for r in rows], "conv_id long, turn int, role string, text string, id int, score double, path string").repartition(3)
    got = {r.conv_id: r for r in chats.read_back(chats.formatted(chats.chains(frame), turns=turns)).collect()}
    by_conv = collections.defaultdict(list)
    for c, t, role, text in rows:
        role, text = role or "", text or ""
        by_conv[c].append((t is None, t or 0, role, hashlib.md5(text.encode()).hexdigest(), text))
    assert set(got) == set(by_conv)
    for c, held in by_conv.items():
        held = [(role, text) for *_, role, _, text in sorted(held)]
        learned = "".join(t for r, t in held if r == "assistant")
        r = got[c]
        assert (r.n_turns, r.turns_sha256) == (len(held), sha("".join(f"{a}\n{b}\n" for a, b in held)))
        assert (r.loss_chars, r.loss_sha256) == (len(learned), sha(learned)) and r.formatted_chars > sum(len(b) for _, b in held)


def plain_branches(messages, keep):
    by_id = {i: (c, p, s or 0.0) for c, i, p, s in messages}
    up = {i: p if p in by_id and by_id[p][0] == c else None for i, (c, p, _) in by_id.items()}
    inner, out = {p for p in up.values() if p}, collections.defaultdict(list)
    for leaf in set(by_id) - inner:
        path = [leaf]
        while up[path[-1]] and len(path) <= len(by_id):
            path.append(up[path[-1]])
        if len(path) <= len(by_id):
            out[by_id[leaf][0]].append((-sum(by_id[i][2] for i in path) / len(path), leaf, path[::-1]))
    return {(leaf, tuple(path)) for held in out.values() for _, leaf, path in sorted(held)[:keep]}


@pytest.mark.parametrize("keep", [1, 3])
def test_branches_of_trees(spark, keep):
    messages = []
    for c in range(6):
        for k in range(40):
            parent = None if k == 0 else f"{c}-{RNG.randrange(k)}" if RNG.random() < 0.5 else f"{c}-{k - 1}"
            messages.append((c, f"{c}-{k}", parent, RNG.choice([None, 0.25, 0.5, 1.0])))
    messages += [(9, "x", "y", 1.0), (9, "y", "x", 1.0), (9, "z", "x", 1.0), (9, "w", "missing", 0.5), (9, "v", "0-0", 0.5), (10, "long0", None, 0.0)]
    messages += [(10, f"long{k}", f"long{k - 1}", 0.0) for k in range(1, 70)]
    frame = spark.createDataFrame(messages, "conv int, id string, parent string, score double").repartition(3)
    rows = chats.branches(frame, keep).collect()
    paths = collections.defaultdict(list)
    for r in rows:
        paths[r.path].append((r.pos, r.id))
        assert r["last"] >= r.pos
    got = {(leaf, tuple(i for _, i in sorted(held))) for leaf, held in paths.items()}
    assert got == plain_branches(messages, keep) and all([p for p, _ in sorted(h)] == list(range(len(h))) for h in paths.values())


# Filter interactions

def fails(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return [len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), bool(re.search(r"[#$%&*|]", text))]


def plain_audit(rows, labels):
    good, toxic = ({d for d, *marks in labels if d is not None and marks[k] == 1} for k in (0, 1))
    docs = [(d, t or "", s or "") for d, t, s in rows]
    least = {}
    for d, t, _ in docs:
        if d is not None:
            least[t] = min(d, least.get(t, d))
    failed = [[*fails(t), d is not None and d > least[t]] for d, t, _ in docs]
    parts, orders, out = sorted({s for *_, s in docs}), ["".join(p) for p in itertools.permutations("ABCDE")], {}
    for order in orders:
        alive = list(range(len(docs)))
        for step, f in enumerate(order):
            k = "ABCDE".index(f)
            gone = [i for i in alive if failed[i][k]]
            alive = [i for i in alive if not failed[i][k]]
            for part in parts:
                mine = [i for i in gone if docs[i][2] == part]
                every = [i for i in range(len(docs)) if docs[i][2] == part and failed[i][k]]
                out[(part, order, step + 1)] = [
                    sum(docs[i][2] == part for i in alive), len(mine), len(every) - len(mine), sum(sum(failed[i]) == 1 for i in every),
                    sum(docs[i][0] in good for i in mine), sum(docs[i][0] in toxic for i in mine),
                ]
    shapley = collections.Counter()
    for (part, order, step), row in out.items():
        shapley[(part, order[step - 1])] += row[1]
    return {(*key, *row, shapley[(key[0], key[1][key[2] - 1])]) for key, row in out.items()}


@pytest.mark.parametrize("files, batches", [(1, 4), (7, 7), (7, 2)])
def test_filter_audit(spark, tmp_path, files, batches):
    texts = [None, "", "short $", "word " * 60, " ".join(f"w{i}" for i in range(70)), " ".join(f"W{i}" for i in range(70)), "ÄÖ " * 60 + "A|", "#" * 9000]
    rows = [(RNG.choice([None, *range(40)]), RNG.choice(texts), RNG.choice([None, "a", "b"])) for _ in range(160)]
    rows += [(900 - i, texts[4], "hot") for i in range(60)] + [rows[5], rows[5]]  # smaller ids come later
    labels = [(i, i % 2, i % 3 == 0 and 1 or 0) for i in range(40)] + [(3, 1, 1), (3, 0, 0), (None, 1, 1), (7, None, None)]
    frame = spark.createDataFrame([(*r, 1, "m", 2) for r in rows], "doc_id long, text string, source string, n int, mask string, good int")
    path = str(tmp_path / "d.parquet")
    frame.repartition(files).write.parquet(path)
    marked = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = [tuple(r) for r in interactions.audit(spark, path, marked, batches=batches).collect()]
    assert len(got) == len(set(got)) == 600 * 4 and set(got) == plain_audit(rows, labels)


def test_filter_audit_of_no_rows(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, source string").write.parquet(str(tmp_path / "d"))
    marked = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert interactions.audit(spark, str(tmp_path / "d"), marked).count() == 0


# Divergence

def plain_divergence(rows, top):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for text, lang, source in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        seen = collections.Counter(t for d in mine for t in set(d[2]))
        kept = {t for t, n in seen.items() if n >= 3}
        count = {s: collections.Counter(t for d in mine if d[1] == s for t in d[2] if t in kept) for s in {d[1] for d in mine}}
        whole = sum(count.values(), collections.Counter())
        share = lambda c: {t: 1 + 10 ** 9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}
        p = {s: share(c) for s, c in count.items()}
        q = share(whole)
        price = lambda x, y: (x - y) * (x - y) // y
        for s in count:
            pairs = sorted((-sum(price(p[s][t], p[o][t]) for t in kept), o.encode()) for o in count if o != s)
            terms = sorted((-price(p[s][t], q[t]), t.encode()) for t in kept if count[s][t] and p[s][t] > q[t])[:top]
            for part, held in (("pair", pairs), ("term", terms)):
                out |= {(lang, s, part, item.decode(), -value, rank + 1) for rank, (value, item) in enumerate(held)}
    return out


def corpus(n, sources):
    words = [RNG.choice(["Ab", "x", "é", "ß-", "\x00", "Ö"]) + "".join(RNG.choice("abcAB'Ñ") for _ in range(RNG.randrange(4))) for _ in range(60)]
    return [(RNG.choice([None, "", " ".join(RNG.choice(words[:RNG.randrange(2, 60)]) for _ in range(RNG.randrange(80)))]), RNG.choice([None, "l1", "l2"]), RNG.choice([None, *sources])) for _ in range(n)]


@pytest.mark.parametrize("rows, columns, held", [(64, 1024, 500_000), (4, 8, 30)])
def test_divergence(spark, rows, columns, held):
    texts = corpus(150, [f"s{i}" for i in range(9)]) + [("once only", "rare", "s1"), (None, "rare", "s2"), ("z" * 30_000 + " Zz", "l1", "s1")] * 2
    frame = spark.createDataFrame([(*t, 1, "k", 5) for t in texts], "text string, lang string, source string, n int, item string, value int").repartition(4)
    got = [tuple(r) for r in divergence.audit(frame, top=5, rows=rows, columns=columns, held=held).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_divergence(texts, 5)
    assert divergence.audit(frame.limit(0)).count() == 0


def test_shares_of_large_counts(spark):
    counts = [(1, 1), (3, 7), (10 ** 14 + 7, 10 ** 15 + 1), (8 * 10 ** 15, 9 * 10 ** 15), (1, 9 * 10 ** 15)]
    frame = spark.createDataFrame(counts, "c long, w long").select(divergence.share(F.col("c"), F.col("w")).alias("s"))
    want = [1 + 10 ** 9 * c // w for c, w in counts]
    assert [r.s for r in frame.collect()] == want
    c, w = (np.array(x, dtype=np.int64) for x in zip(*counts))
    assert divergence._shares(c, w).tolist() == want

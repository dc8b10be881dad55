"""Operators 11 to 13 against brute force: nulls, ties, repeated rows, empty tables, clashing columns, hot keys, collisions, chains."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from quillgraph.llm import divergence, exactdedup, trie

EXTRA = "row int, digest string, n long, key string, top int, depth int, place long, size int"
VALUES = (1, "d", 2, "k", 3, 4, 5, 6)


def same(got, want):
    order = lambda rows: sorted(rows, key=lambda r: tuple((x is None, x) if not isinstance(x, str) else (False, x) for x in r))
    assert order(map(tuple, got)) == order(want)


# --- exact dedup


def dedup_by_hand(docs):
    groups = defaultdict(list)
    for i, text in docs:
        groups[hashlib.sha256(re.sub("[ \t-\r]", "", text or "").encode()).hexdigest()].append((-len(text or ""), i is None, i or 0, i))
    out = []
    for digest, rows in groups.items():
        rows.sort(key=lambda r: r[:3])
        out += [(r[3], rows[0][3], len(rows), k == 0, digest) for k, r in enumerate(rows)]
    return out


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(2)
    words = ["a", "b c", " ", "\t", "É", " ", "\x0b", "xyz\n"]
    rows = [(i, "".join(rng.choice(words) for _ in range(rng.randrange(5)))) for i in range(300)]
    return [*rows, (None, None), (None, "a"), (5, None), (7, "a  "), (7, "a  "), (7, " a "), (900, "long " * 3000), (901, "long" * 3000), (902, "  long " * 3000), *[(k, "hot") for k in range(1000, 1400)]]


def test_exact_dedup(spark, docs):
    rows = spark.createDataFrame([(*d, *VALUES) for d in docs], f"doc_id long, text string, {EXTRA}")
    same(exactdedup.deduplicated(rows).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect(), dedup_by_hand(docs))
    assert exactdedup.deduplicated(rows.where("false")).count() == 0


def test_index_stays_between_loads(spark, docs, tmp_path):
    path = f"{tmp_path}/index"
    half = [d for k, d in enumerate(docs) if k % 2], [d for k, d in enumerate(docs) if not k % 2]
    first, second = (exactdedup.deduplicated(spark.createDataFrame(h, "doc_id long, text string"), path, 3).collect() for h in half)
    same(first, dedup_by_hand(half[0]))
    known = {r.text_sha256: r.keep_id for r in first}
    assert all(not r.kept and r.keep_id == known[r.text_sha256] for r in second if r.text_sha256 in known)
    assert Counter(r.text_sha256 for r in second if r.kept) == Counter({r.text_sha256 for r in second} - set(known))
    name = exactdedup.open_index(spark, path)
    assert spark.table(name).count() == len(set(known) | {r.text_sha256 for r in second})
    smaller = exactdedup.compacted(spark, path, f"{tmp_path}/compact")
    same(spark.table(smaller).collect(), spark.table(name).collect())
    again = exactdedup.deduplicated(spark.createDataFrame(half[0], "doc_id long, text string"), f"{tmp_path}/compact")
    assert not again.where("kept").count()


def test_index_is_not_shuffled(spark, docs, tmp_path):
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    exactdedup.deduplicated(rows, f"{tmp_path}/index", 4)  # as many buckets as shuffle partitions
    index = exactdedup.open_index(spark, f"{tmp_path}/index")
    plan = exactdedup.unknown(spark, index, exactdedup.leaders(exactdedup.digest_rows(rows)))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan


# --- prefix trie


def trie_by_hand(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    for turns in own.values():
        turns.sort()
    made = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        made[c] = tuple(t[2:] for t in own.get(c - c % 5, [])[:h]) + tuple(t[2:] for t in turns[h:])
    members = defaultdict(list)
    for c in sorted(made):
        for d in range(len(made[c]) + 1):
            members[made[c][:d]].append(c)
    children, leaves, saved = Counter(p[:-1] for p in members if p), Counter(), Counter()
    for p, who in members.items():
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(who) - 1) * len(p[-1][1].encode()) if p else 0
            leaves[p[:d]] += not children[p]
    return [(who[0], len(p), members[p[:-1]][0] if p else None, len(who), children[p], leaves[p], saved[p], hashlib.sha256(",".join(str(c) for c in who if len(made[c]) == len(p)).encode()).hexdigest()) for p, who in members.items()]


def conversations(seed):
    rng = random.Random(seed)
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["hi", "hello É", "", None, "x" * 40])) for c in range(60) for t in range(rng.randrange(6))]
    rows += [(200, t, "user", "same") for t in range(120)] + [(201, t, "user", "same") for t in range(90)] + [(203, t, "user", f"turn {t}") for t in range(100)]
    rows += [(c, 0, "user", "hot") for c in range(300, 420)]
    return [*rows, (None, 0, "user", "lost"), (61, None, "b", "2"), (61, None, "a", "3"), (61, None, "a", None), (61, 1, "a", "3"), (61, 1, "a", "3"), (61, 1, None, None), (64, 0, "user", "short")]


@pytest.mark.parametrize("limit", [2, 15, 5000])
def test_trie(spark, limit):
    rows = conversations(limit)
    frame = spark.createDataFrame([(*r, *VALUES) for r in rows], f"conv_id long, turn long, role string, text string, {EXTRA}")
    same(trie.prefix_trie(frame, limit).collect(), trie_by_hand(rows))


def test_no_conversations(spark):
    frame = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert trie.prefix_trie(frame).count() == 0
    one = spark.createDataFrame([(3, 0, "user", "only")], frame.schema)  # its opening is that of an absent conversation
    same(trie.prefix_trie(one).collect(), trie_by_hand([(3, 0, "user", "only")]))


def test_component_sums():
    rng = random.Random(4)
    for n in (1, 2, 3, 10, 400):
        for shape in ("chain", "star", "random"):
            parents = [-1] + [i - 1 if shape == "chain" else 0 if shape == "star" else rng.randrange(i) for i in range(1, n)]
            values = [(rng.randrange(5), rng.randrange(100)) for _ in range(n)]
            want = [list(v) for v in values]
            for i in reversed(range(1, n)):
                want[parents[i]] = [a + b for a, b in zip(want[parents[i]], want[i], strict=True)]
            assert trie.component_sums(parents, values) == want


# --- source divergence


def audit_by_hand(docs, least):
    rows = [(lang or "", source or "", re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for text, lang, source in docs]
    out = []
    for lang in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == lang]
        seen = Counter(t for r in mine for t in set(r[2]))
        kept = {t for t in seen if seen[t] >= least}
        counts = {s: Counter(t for r in mine if r[1] == s for t in r[2] if t in kept) for s in {r[1] for r in mine}}
        p = lambda c, t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept))
        f = lambda a, b: (a - b) ** 2 // (a + b)
        everything = sum(counts.values(), Counter())
        for s, c in counts.items():
            pairs = sorted(((-sum(f(p(c, t), p(o, t)) for t in kept), x.encode(), x) for x, o in counts.items() if x != s))
            terms = sorted((-f(p(c, t), p(everything, t)), t.encode(), t) for t in kept if c[t] and p(c, t) > p(everything, t))[:10]
            out += [(lang, s, part, item, -v, k + 1) for part, found in (("pair", pairs), ("term", terms)) for k, (v, _, item) in enumerate(found)]
    return out


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(6)
    vocabulary = ["the", "The", "É", "é", "中文", "x" * 50, "zz", *[f"w{'abcdefghij'[i % 10]}{'klmno'[i // 10]}" for i in range(40)]]
    rows = [(" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(30))), rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "é", None])) for _ in range(150)]
    return [*rows, (None, "en", "empty"), ("", None, None), ("one two", "fr", "a"), ("!!", "fr", "b"), ("only", "it", "c"), *[("hot word hot", "en", "s1")] * 200]


@pytest.mark.parametrize("bits", [64, 4, 1])
def test_audit(spark, texts, bits):
    frame = spark.createDataFrame([(*t, *VALUES) for t in texts], f"text string, lang string, source string, {EXTRA}")
    same(divergence.audit(frame, 5, bits=bits).collect(), audit_by_hand(texts, 5))


def test_audit_of_nothing(spark):
    assert divergence.audit(spark.createDataFrame([], "text string, lang string, source string")).count() == 0


def test_shares_are_exact():
    import numpy as np

    rng = random.Random(8)
    totals = [rng.randrange(1, 2**52) for _ in range(500)]
    counts = [rng.randrange(1, t + 1) for t in totals]
    assert divergence.shares(np.array(counts), np.array(totals)).tolist() == [1 + 10**9 * c // t for c, t in zip(counts, totals, strict=True)]

"""The prefix trie, the removal of repeats and the ranked search against plain versions, with odd rows and forced routes."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

pytest.importorskip("tallgrass.llm")

from tallgrass.llm import repeats, search, trie  # noqa: E402

# Conversations.


def plain_trie(convs, rows):
    """convs: ids; rows: id -> list of (role, text), rebuilt. One row a node."""
    members, ends = defaultdict(list), defaultdict(list)
    for c in convs:
        turns = tuple(rows[c])
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
        ends[turns].append(c)
    children = Counter(n[:-1] for n in members if n)
    out = []
    for node, own in members.items():
        below = [n for n in members if n[: len(node)] == node]
        saved = sum((len(members[n]) - 1) * (len(n[-1][1].encode()) if n else 0) for n in below)
        shown = hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest()
        out.append((min(own), len(node), min(members[node[:-1]]) if node else None, len(own), children[node], sum(not children[n] for n in below), saved, shown))
    return sorted(out, key=str)


def plain_rebuilt(rows):
    """rows: (conv_id, turn, role, text)."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, role, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), text))
    turns = {c: [(r, t) for *_, r, _, t in sorted(given)] for c, given in own.items()}
    out = {}
    for c, given in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = turns.get(c - c % 5, [])[:h] + given[h:]
    return out


def shown(df):
    return sorted(((r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect()), key=str)


def test_trie_query(spark, small):
    rows = plain_rebuilt([(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{small}/conversations.parquet").collect()])
    assert shown(trie.op11_prefix_trie(spark, small)) == plain_trie(rows, rows)


@pytest.mark.parametrize("narrow", [False, True])
def test_trie_of_odd_rows(spark, tmp_path, monkeypatch, narrow):
    if narrow:  # a sketch so small that nothing is proven to be alone; ends in many parts
        monkeypatch.setattr(trie, "MOST_WIDTH", 4)
        monkeypatch.setattr(trie, "IDS", 3)
    rng = random.Random(7)
    rows = [(c, t, rng.choice(["user", None]), rng.choice(["a", "b", "", None, "ü"])) for c in range(60) for t in range(rng.randint(1, 4))]
    rows += [(c, t, "user", f"same {t}") for c in range(100, 130) for t in range(12)]  # one group of equal conversations
    rows += [(200, None, "user", "first"), (200, 3, "user", "tie"), (200, 3, "assistant", "tie"), (200, 3, "user", "tie"), (None, 1, "user", "nobody"), (203, 1, None, None), (204, 1, "user", "x" * 100_000)]
    given = spark.createDataFrame([(*r, 1, "clash") for r in rows], "conv_id long, turn long, role string, text string, depth int, conv string")
    given.write.parquet(str(tmp_path / "conversations.parquet"))
    want = plain_rebuilt(rows)
    assert shown(trie.op11_prefix_trie(spark, str(tmp_path))) == plain_trie(want, want)


def test_trie_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    assert trie.op11_prefix_trie(spark, str(tmp_path)).count() == 0


# Repeats.


def plain_repeats(texts, size):
    """For each text of bytes: its spans to remove."""
    seen = Counter(t[i : i + size] for t in texts for i in range(len(t) - size + 1))
    out = []
    for t in texts:
        spans = []
        for i in range(len(t) - size + 1):
            if seen[t[i : i + size]] > 1:
                if spans and i <= spans[-1][1]:
                    spans[-1] = (spans[-1][0], i + size)
                else:
                    spans.append((i, i + size))
        out.append(spans)
    return out


def without(text, spans):
    return b"".join(text[a:b] for a, b in zip([0, *(e for _, e in spans)], [*(s for s, _ in spans), len(text)], strict=True))


def test_repeats_query(spark, small):
    rows = spark.read.parquet(f"{small}/documents.parquet").collect()
    texts = [(r.text or "").encode() for r in rows]
    want = sorted((r.doc_id, len(t), sum(b - a for a, b in s), len(s), hashlib.sha256(without(t, s)).hexdigest()) for r, t, s in zip(rows, texts, plain_repeats(texts, 400), strict=True))
    assert any(w[2] for w in want)
    got = repeats.op12_run_length_dedup(spark, small)
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect()) == want


@pytest.mark.parametrize("deep", [False, True])
def test_repeats_of_odd_rows(spark, monkeypatch, deep):
    if deep:  # every key is too large, regions and parts are short, blocks hold one key
        for name, value in (("KEY_BYTES", 1), ("REGION", 7), ("PART", 50), ("BLOCK_BYTES", 1)):
            monkeypatch.setattr(repeats, name, value)
    rng = random.Random(3)
    passage = "the passage that many texts hold, in this or another place "
    texts = [None, "", "short", "a" * 300, "ab" * 90, "é" * 40, passage, passage, "x\x00y" * 30]
    texts += ["".join(rng.choices("abc ", k=rng.randint(0, 40))) + passage[rng.randint(0, 20) :] + "".join(rng.choices("abc ", k=rng.randint(0, 40))) for _ in range(40)]
    rows = [(i if i % 7 else None, t, "clash", 5, i) for i, t in enumerate(texts)]
    given = spark.createDataFrame(rows, "doc_id long, text string, h string, kept_bytes int, place int")
    got = {r.place: r for r in repeats.remove_repeats(given, size=25).collect()}
    plain = [(t or "").encode() for t in texts]
    for i, (t, spans) in enumerate(zip(plain, plain_repeats(plain, 25), strict=True)):
        assert [(s.start, s.end) for s in got[i].repeat_spans] == spans, (i, t)
        assert bytes(got[i].kept_bytes) == without(t, spans) and got[i].h == "clash"
    if not deep:
        assert repeats.remove_repeats(given.limit(0), size=25).count() == 0


def test_run_length_index():
    rng = random.Random(1)
    for _ in range(300):
        letters = rng.choice([b"ab", b"abc", b"abcdefgh", b"a"])
        size = rng.randint(2, 5)
        texts = [t for t in {bytes(rng.choices(letters, k=rng.randint(5, 60))) for _ in range(rng.randint(1, 8))} if len(t) >= size]
        if texts:
            seen = Counter(t[i : i + size] for t in texts for i in range(len(t) - size + 1))
            want = [repeats._runs(np.array([seen[t[i : i + size]] > 1 for i in range(len(t) - size + 1)])) for t in texts]
            assert repeats.repeated_in(texts, [1] * len(texts), size) == want
    copies = b"\xff".join([bytes(rng.choices(b"abcdefgh ", k=500))] * 40 + [b""])
    index = repeats.RunLengthIndex(np.frombuffer(copies, np.uint8))
    assert index.lengths.sum() == len(copies) and len(index.heads) < len(copies) / 20  # copies cost no runs


# Search.


def plain_search(docs, items, top=50):
    """docs: (id, text); items: (id, text)."""
    cut = lambda t: re.findall("[0-9a-z\\u0080-\\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    given = [(i, Counter(cut(t))) for i, t in docs]
    given = [(i, c, sum(c.values())) for i, c in given if c]
    n_docs, n_words = len(given), sum(n for *_, n in given)
    df = Counter(t for _, c, _ in given for t in c)
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for t, n in df.items()}
    wanted = defaultdict(set)
    for i, t in items:
        wanted[i] |= set(cut(t))
    out = []
    for item, terms in wanted.items():
        scores = []
        for i, c, n in given:
            m = 100 - 50 + (50 * n * n_docs) // n_words
            score = sum(weight[t] * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m)) for t in terms if t in c)
            if score > 0:
                scores.append((-score, i is None, i or 0))
        out += [(item, k, None if no_id else i, -s) for k, (s, no_id, i) in enumerate(sorted(scores)[:top], 1)]
    return sorted(out, key=str)


def found(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=str)


def test_search_query(spark, small):
    docs, items = (spark.read.parquet(f"{small}/{t}.parquet").collect() for t in ("documents", "benchmark"))
    assert found(search.op13_shared_sum_search(spark, small)) == plain_search([(r.doc_id, r.text) for r in docs], [(r.item_id, r.text) for r in items])


@pytest.mark.parametrize("blocks", [False, True])
def test_search_of_odd_rows(spark, monkeypatch, blocks):
    if blocks:  # several blocks of items, a few documents at a time, few sets whose pairs are counted
        for name, value in (("BLOCK_ITEMS", 4), ("CELLS", 200), ("MOST_SETS", 3)):
            monkeypatch.setattr(search, name, value)
    rng = random.Random(5)
    words = ["the", "of", "AND", "rare1", "rare2", "é9", "x_y", "ÀB", *(f"w{i}" for i in range(20))]
    text = lambda most: " ".join(rng.choices(words, k=rng.randint(0, most)))
    docs = [(i, text(60)) for i in range(60)] + [(None, "the of"), (None, "the of"), (3, "the of"), (3, "the of"), (70, None), (71, ""), (72, "the " * 50_000), (73, " -- ")]
    items = [(i, text(12)) for i in range(12)] + [(3, "the rare1"), (50, None), (51, ""), (None, "of and"), (52, "unknown"), (53, "the the THE")]
    given = spark.createDataFrame([(*d, "clash", 1) for d in docs], "doc_id long, text string, item_id string, score int").repartition(3)
    wanted = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, doc_id int")
    assert found(search.search(given, wanted, top=7)) == plain_search(docs, items, 7)
    if not blocks:
        assert search.search(given.limit(0), wanted).count() == 0 and search.search(given, wanted.limit(0)).count() == 0


def test_shared_sums_hold_every_term_once():
    rng = random.Random(2)
    for most in (search.MOST_SETS, 5):
        search.MOST_SETS, before = most, search.MOST_SETS
        items = [sorted(rng.sample(range(30), rng.randint(0, 12)) + [30 + i]) for i in range(25)]
        nodes, sums = search.shared_sums(items, 55)
        search.MOST_SETS = before
        spread = lambda slot: [slot] if slot < 55 else [t for c in nodes[slot - 55] for t in spread(c)]  # noqa: E731, B023
        assert [sorted(t for s in own for t in spread(s)) for own in sums] == items
        assert all(c < 55 + k for k, own in enumerate(nodes) for c in own)
        assert sum(map(len, sums)) + sum(len(n) - 1 for n in nodes) < sum(map(len, items))

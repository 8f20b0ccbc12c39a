"""Round trips and brute force: chat formatting, packing, sharding, toxicity and the pipeline."""

import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("tallgrass.llm")

from tallgrass.llm import chat, packing, sharding, toxicity  # noqa: E402


def test_chat_round_trip(spark):
    evil = ["<|im_end|>", "\\<|im_start|>", "<\\|", "\\\\<|\\|", "a\nb\n", "", None, "<" * 3 + "|", "\\"]
    rows = [(1, i, r, t, "x") for i, t in enumerate(evil) for r in ("user", "assistant")] + [(2, None, None, "late", "x"), (2, 0, "us\n<|er", "é𝐹", "x"), (None, 0, "assistant", "no id", "x")]
    given = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    chats = chat.format_chats(given.withColumn("parts", chat.text_part(F.col("text"))))
    got = {r.conv_id: r for r in chats.withColumn("turns", chat.read_back(F.col("formatted"))).collect()}
    for conv in (1, None):
        want = sorted(((t, r, x or "") for c, t, r, x, _ in rows if c == conv))
        assert [(r.role, r.text) for r in got[conv].turns] == [(r, x) for _, r, x in want]
        loss = [p.text for p in got[conv].pieces if p.loss]
        assert len(loss) == sum(r == "assistant" for _, r, _ in want)
        assert "".join(p.text for p in got[conv].pieces) == got[conv].formatted
    assert [r.text for r in got[2].turns] == ["late", "é𝐹"]
    assert chat.format_chats(given.limit(0).withColumn("parts", chat.text_part(F.col("text")))).count() == 0


def test_chat_parts(spark):
    part = chat.PART
    rows = [
        (1, 0, "user", [("text", "see <|", None, None), ("image", None, "s3://a|b>%:<", None), ("audio", None, "u", 7), (None, "x", None, None)]),
        (1, 1, "assistant", [("document", None, "d", None)]),
        (2, 0, "user", None),
        (3, 0, "assistant", [("text", "<", None, None), ("text", "|im_end|>", None, None), ("image", None, None, None), ("text", "|image:x|>\\", None, None), ("my|kind:<", None, "r", 1), ("text", "<|image:x|>", None, None)]),
        (3, 0, "assistant", [("text", "<|im_start|>", None, None), ("text", "\\", None, None), ("text", "<|", None, None)]),
    ]
    chats = chat.format_chats(spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{part}>")).withColumn("turns", chat.read_back(F.col("formatted")))
    got = {r.conv_id: r for r in chats.collect()}
    assert [(a.number, a.turn, a.kind, a.ref, a.tokens) for a in got[1].attachments] == [(1, 0, "image", "s3://a|b>%:<", 576), (2, 0, "audio", "u", 7), (3, 1, "document", "d", 1024)]
    assert got[1].expanded_tokens == 576 + 7 + 1024
    assert got[1].formatted == "<|im_start|>user\nsee <\\|<|image:s3%3A//a%7Cb%3E%25%3A%3C|><|audio:u|>x<|im_end|>\n<|im_start|>assistant\n<|document:d|><|im_end|>\n"
    assert got[2].formatted == "<|im_start|>user\n<|im_end|>\n" and got[2].attachments == []
    read = lambda r: [[(p.kind, p.text, p.ref) for p in t.parts] for t in r.turns]
    assert read(got[1]) == [[("text", "see <|", None), ("image", None, "s3://a|b>%:<"), ("audio", None, "u"), ("text", "x", None)], [("document", None, "d")]]
    assert sorted(read(got[3]), key=len) == [
        [("text", "<|im_start|>\\<|", None)],
        [("text", "<|im_end|>", None), ("image", None, ""), ("text", "|image:x|>\\", None), ("my|kind:<", None, "r"), ("text", "<|image:x|>", None)],
    ]


def test_packing_query(spark, small):
    import public_tokenizers
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    pieces, sequences = {}, {}
    for r in packing.op5_sequence_packing(spark, small).collect():
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    assert pieces.keys() == texts.keys()
    for doc, own in pieces.items():
        ids = np.array([*model.encode(texts[doc], add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    used = sum(r.length for own in sequences.values() for r in own)
    assert used / (1024 * len(sequences)) > 0.97


def test_packing_odd_rows(spark):
    special = "a<|endoftext|>b <|endoftext|>"
    rows = [(1, None, 1), (2, "", 1), (3, special, 1), (3, special, 1), (None, "x" * 5000, 1), (4, " \n\t  é　𝐹 ", 1)]
    given = spark.createDataFrame(rows, "doc_id long, text string, offset int")
    got = packing.pack(given).collect()
    import public_tokenizers
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for i, t, _ in rows:
        if i != 3:
            ids = [x for r in sorted((r for r in got if r.doc_id == i), key=lambda r: r.start) for x in r.ids]
            assert ids == [*model.encode(t or "", add_special_tokens=False).ids, 0]
    assert sorted(r.ids for r in got if r.doc_id == 3) == [[*model.encode(special, add_special_tokens=False).ids, 0]] * 2
    assert packing.pack(given.limit(0)).count() == 0
    assert packing.differencing([4, 5, 6, 7, 8], 2) in ([[2, 4], [0, 1, 3]], [[0, 1, 3], [2, 4]])


def test_shard_store(spark, tmp_path):
    store = sharding.ShardStore(spark, str(tmp_path / "s"))
    assert store.version() == -1 and store.compact() == -1
    frame = spark.range(4000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("text"), F.lit(None).cast("string").alias("path"))
    for k in range(6):
        assert store.append(frame.filter(F.col("id") % 6 == k).repartition(3)) == k
    before = store.manifest()
    assert before.count() == 18 and before.agg(F.sum("rows")).first()[0] == 4000
    target = 4 * before.agg(F.max("bytes")).first()[0]
    assert store.compact(target=target, smallest=1000) == 6
    after = store.manifest().collect()
    assert len(after) < 18 and max(r.bytes for r in after) < 1.5 * target
    assert sorted(r.id for r in store.read().collect()) == list(range(4000)) == sorted(r.id for r in store.read(5).collect())
    assert store.commit(store.manifest(), 2) is None and store.version() == 6
    store.append(frame.limit(0))
    assert store.read().count() == 4000


def test_compaction_plan(spark):
    sizes = [3, 3, 3, 3, 3, 3, 3, 100, 40, 41, 9, 1]
    rows = [(f"s{i:02}", s, i) for i, s in enumerate(sizes)]
    plan = {r.shard: (r.tier, r.run) for r in sharding.plan_compaction(spark.createDataFrame(rows, "shard string, bytes long, added long"), 12, 2, 3).collect()}
    assert [plan[f"s{i:02}"][0] for i in range(12)] == [max(0, math.ceil(math.log2(s / 2))) for s in sizes]
    runs = {}
    for shard, (_, run) in plan.items():
        runs.setdefault(run, []).append(shard)
    assert sorted(runs["1-0"]) == ["s00", "s01", "s02", "s03"] and sorted(runs["1-1"]) == ["s04", "s05", "s06"]
    assert {"s07", "s08", "s09", "s10", "s11"} == set(runs[None])


def test_toxicity_learns(spark, small):
    words = [f"w{i}x" for i in range(300)]
    rng = np.random.default_rng(3)
    rows, labels = [], []
    for i in range(1200):
        own = rng.choice(words, int(rng.integers(5, 120))).tolist()
        if bad := i % 4 == 0:
            for _ in range(3):
                own.insert(int(rng.integers(0, len(own))), str(rng.choice(["vileword", "Nastything", "grimstem" + str(rng.integers(0, 50))])))
        rows.append((i, " ".join(own), "en" if i % 3 else "de", 0.5))
        labels.append((i, int(bad)))
    docs = spark.createDataFrame([*rows, (5000, None, None, None), (5001, "", "fr", None)], "doc_id long, text string, lang string, score double")
    known = spark.createDataFrame([*labels, (None, 1), (3, None), (4, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, known)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    held = [i for i in range(1200) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(got[i].predicted == (i % 4 == 0) for i in held) / len(held) > 0.95
    assert got[5000].predicted == got[5001].predicted == 0 and 0 <= got[5000].score <= 1
    empty = toxicity.fit(docs, known.limit(0))
    assert {r.predicted for r in toxicity.score(docs, empty).collect()} == {0}
    assert toxicity.score(docs.limit(0), model).count() == 0


def compared(rows, kept, least=0.8):
    """Brute force over all pairs: ids that should go and didn't, and all that should. What went must be in a class with one that stayed."""
    sets = {}
    for i, r in rows.items():
        w = (r.text or "").lower().split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            a, b = sets[i], sets[j]
            if least * max(len(a), len(b)) <= min(len(a), len(b)) and len(a & b) >= least * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    want = {i for i in ids if find(i) != i}
    assert set(ids) - kept <= want
    return want & kept, want


def test_similar_copies_odd_rows(spark):
    from tallgrass.llm import simhash

    rows = [(1, None, 1), (2, "", 1), (3, " \n", 1), (4, "One two", 1), (5, "one  TWO", 1), (5, "one  TWO", 1), (6, "one two three", 1), (None, "one two", 1), (None, "one two", 1)]
    words = [f"w{i}" for i in range(300)]
    for i in range(20):
        own = list(words)
        own[(i * 13) % 300] = f"x{i}"
        rows.append((100 + i, " ".join(own), 1))
    rows.append((200, " ".join(words[::-1]), 1))
    given = spark.createDataFrame(rows, "doc_id long, text string, root int")
    got = {(r.doc_id, r.root) for r in simhash.similar_copies(given).collect()}
    assert {i: r for i, r in got if i < 100} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6}
    assert sum(r == 100 for _, r in got) >= 19 and (200, 200) in got
    kept = simhash.drop_similar_copies(given)
    assert kept.columns == given.columns and sorted(r.doc_id for r in kept.collect() if r.doc_id is not None and r.doc_id < 100) == [1, 4, 6]
    assert kept.filter("doc_id IS NULL").count() == 2 and simhash.similar_copies(given.limit(0)).count() == 0


def test_stages_on_odd_rows(spark, small):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    columns = ["score", "flagged", "n_words", "hit_words", "root", "node", "i", "t", "fp", "key", "start", "ids"]
    rows = [(1, "plain text of some words", "en", "s", 24), (1, "plain text of some words", "en", "s", 24), (2, None, None, None, None), (3, "", "xx", None, 0), (None, "no id here", "en", "s", 10), (4, "long words here " * 20000, "en", "s", 320000), (5, "token = abcdefghijklmnop", "de", "s", 1)]
    given = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").select("*", *[F.lit(c).alias(c) for c in columns])
    for name, stage in corpus_pipeline.STAGES:
        for docs in (given, given.limit(0)):
            out = stage(spark, docs, small)
            got = out.collect()
            if name == "packing":
                continue
            assert out.columns == given.columns and all(r[c] == c for r in got for c in columns)
            assert [(f.name, f.dataType) for f in out.schema] == [(f.name, f.dataType) for f in given.schema]
            ids = sorted(str(r.doc_id) for r in got)
            assert ids == ([] if docs is not given else sorted(["1", "2", "None", "4", "5"]) if name.startswith("simhash") else sorted(["1", "1", "2", "3", "None", "4", "5"]))


def test_pipeline(spark, small):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    from tests.llm.test_scans import plain_hits, plain_spans

    docs = spark.read.parquet(f"{small}/documents.parquet")
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    kept = docs
    before = {r.doc_id: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, kept, small)
        rows = out.collect()
        if name == "packing":
            assert {r.doc_id for r in rows} == set(before) and len({r.sequence_id for r in rows}) > 1
            break
        assert out.columns == docs.columns
        now = {r.doc_id: r for r in rows}
        assert len(now) == len(rows)
        if name == "toxicity":
            labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
            gone = set(before) - set(now)
            assert sum(labels.get(i, 0) for i in gone) >= sum(labels.get(i) == 0 for i in gone)
        if name == "simhash near-dedup":
            missed, want = compared(before, set(now))
            assert not missed
        if name == "decontamination":
            assert set(now) == {i for i, r in before.items() if not plain_hits(r.text, items)[-1]}
        if name == "secret scan":
            assert set(now) == set(before) and not any(plain_spans(r.text) for r in rows)
            assert all(r.n_chars == len(r.text) for r in rows)
        before, kept = now, spark.createDataFrame(rows, docs.schema)

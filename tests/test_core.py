import hashlib
import itertools
import json
import math
import random
import socket
import statistics
import time
from collections import Counter

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from taleloom import session
from taleloom.functions import arrays as A
from taleloom.functions import render
from taleloom.functions import text as T
from taleloom.operators import arms, batches, bpe, curate, eav, expstats, gates, guard, lineage, logits, minhash, reports, runs, shards, tasks
from taleloom.operators.components import components
from taleloom.plans import experiment_queries
from taleloom.sources import files
from taleloom.streaming import logs

GOOD = "The quiet miller carried a lantern across the bridge and wondered about the rain."
CORPUS = ["The cat sat on the mat. ", "A cat and a hat, and that was that. ", "It's the hat that sat! "]
TRICKY = ["", " ", "naïve café", "日本語 テキスト", "👨‍👩‍👧 family", "a\0b", "don't we'll it's", "a" * 500, "tab\tand\nline", "x  y   z"]


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_text_classes(spark):
    rows = frame(spark, [("a b　c\x1cd  e",), ("",), ("one",)], "t string")
    got = [r[0] for r in rows.select(T.word_count(F.col("t"))).collect()]
    assert got == [5, 0, 1]
    assert [r[0] for r in rows.limit(1).select(T.visible(F.lit("a b\n"))).collect()] == ["a·b⏎"]
    assert frame(spark, [(1.0,), (0.9,), (0.25,)], "x double").select(T.general(F.col("x"))).collect() == [("1",), ("0.9",), ("0.25",)]


def test_filters_name_the_first_failure(spark):
    cases = [
        ("short", "too_short"), ("onewordthatislongenough", "too_few_words"), ("12345 67890 !!!! @@@@ ####", "mostly_non_alphabetic"),
        ("same line here\n" * 4, "repetitive_lines"), ("some words with \x07 a bell", "control_characters"), (GOOD, None),
    ]
    got = frame(spark, cases, "text string, want string").select("want", curate.reject_reason(F.col("text"))).collect()
    assert all(a == b for a, b in got)


def test_split_depends_on_content_only(spark):
    rows = frame(spark, [(i, f"Document {i % 50}. {GOOD}") for i in range(100)], "doc_id long, text string")
    got = curate.curated_columns(rows).groupBy("text").agg(F.countDistinct("split").alias("n")).where("n > 1")
    assert got.count() == 0


def test_curate_report(spark):
    texts = [f"Document {i}. {GOOD} It carried on for a while after that number {i * 7919}." for i in range(10)]
    rows = frame(spark, list(enumerate(texts + texts[:3] + ["short", "xxxxx"])), "doc_id long, text string")
    out = minhash.curate(rows, near_duplicate_threshold=None)
    stages = {r["stage"]: (r["remaining"], r["removed"]) for r in out["stages"].collect()}
    assert stages == {"input": (15, 0), "exact_duplicates": (12, 3), "quality": (10, 2)}
    assert {tuple(r) for r in out["rejections"].collect()} == {("too_short", 2)}
    assert {r["doc_id"] for r in out["kept"].collect()} == set(range(10))


def test_minhash_groups(spark):
    base = "the quick brown fox jumps over the lazy dog near the river bank " * 8
    rows = [(0, base), (1, base.replace("lazy", "idle", 1)), (2, "completely different words about ships and harbours in winter " * 8), (3, base)]
    signed = minhash.signatures(frame(spark, rows, "doc_id long, text string"))
    got = {r["doc_id"]: r["component"] for r in minhash.duplicate_groups(signed, 64, 0.7).collect()}
    assert got == {0: 0, 1: 0, 3: 0}
    with pytest.raises(ValueError, match="equal size"):
        minhash.candidates(minhash.classes(signed), 64, 7)
    assert components(frame(spark, [], "a long, b long")).count() == 0
    chain = frame(spark, [(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    assert {tuple(r) for r in components(chain).collect()} == {(i, 0) for i in range(41)} | {(100, 100), (101, 100)}


def joined(ids, pair, new):
    text = ",".join(map(str, ids))
    done = regex.sub(rf"(?<![^,]){pair[0]},{pair[1]}(?![^,])", str(new), text)
    return [int(i) for i in done.split(",")]


def test_signatures_by_plain_arithmetic():
    a, b = minhash.draws(5)
    simple = np.array(minhash.draws31(5), np.uint64)
    texts = [*TRICKY, "longer text " * 30, "abcdefgh", "abcdefghi"] * 8
    exact, other = minhash.signature_matrix(texts, a, b), minhash.signature_matrix(texts, simple[:, 0], simple[:, 1], exact=False)
    for text, x, y in zip(texts, exact, other, strict=True):
        data = text.encode()
        grams = {data[i : i + 8] for i in range(max(1, len(data) - 7))}
        h = [int.from_bytes(hashlib.blake2b(g, digest_size=8).digest(), "big") % minhash.M61 for g in grams]
        assert x.tolist() == [min((v * int(p) + int(q)) % 2**64 % minhash.M61 for v in h) for p, q in zip(a, b, strict=True)]
        h = [int(hashlib.md5(text[i : i + 8].encode()).hexdigest()[:15], 16) % minhash.M31 for i in range(max(1, len(text) - 7))]
        assert y.tolist() == [min((v * int(p) + int(q)) % minhash.M31 for v in h) for p, q in simple]


def naive_merges(words, count):
    words, out = [(list(w.encode()), n) for w, n in words], {}
    while len(out) < count:
        pairs = {}
        for ids, n in words:
            for p in zip(ids, ids[1:], strict=False):
                pairs[p] = pairs.get(p, 0) + n
        if not pairs or max(pairs.values()) < 2:
            break
        best = min(pairs, key=lambda p: (-pairs[p], p))
        out[best] = 256 + len(out)
        words = [(joined(ids, best, out[best]), n) for ids, n in words]
    return out


def test_bpe_against_naive_training(spark, tmp_path):
    rng = random.Random(7)
    vocabulary = ["".join(rng.choice("abcdeilnorst") for _ in range(rng.randint(2, 7))) for _ in range(150)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(200)) for _ in range(10)] + CORPUS * 5
    docs = frame(spark, list(enumerate(texts)), "doc_id long, text string")
    tokenizer = bpe.train(docs, 400, ("<|endoftext|>",))
    chunks = [(r["chunk"], r["n"]) for r in bpe.chunk_counts(docs).collect()]
    assert tokenizer.merges == naive_merges(chunks, 400 - 257)
    some = frame(spark, [("\0a\0a", 3), ("aaaa", 2), ("éé été", 5), ("", 9), ("banana", 4), ("x", 50)], "chunk string, n long")
    assert bpe.learn_distributed(some, 18) == bpe.learn([(r["chunk"], r["n"]) for r in some.collect()], 18)
    for text in TRICKY + texts[:3]:
        assert tokenizer.decode(tokenizer.encode_ordinary(text)) == text
    end = tokenizer.special_tokens["<|endoftext|>"]
    assert tokenizer.encode("a<|endoftext|>b").count(end) == 1 and end not in tokenizer.encode("a<|endoftext|>b", allow_special=False)
    with pytest.raises(ValueError, match="unknown"):
        tokenizer.decode([10**6])
    tokenizer.save(str(tmp_path / "t.json"))
    assert bpe.load(str(tmp_path / "t.json")).fingerprint() == tokenizer.fingerprint()
    chars = bpe.CharTokenizer(list("abc"))
    assert chars.decode(chars.encode("abcz")) == "abc�" and chars.decode([99]) == "�"


def test_shards_round_trip(spark, tmp_path):
    docs = frame(spark, [(i, [i % 7] * (10 + i)) for i in range(40)], "doc_id long, ids array<int>")
    shards.write_shards(docs, str(tmp_path), "train", 300, "abc", shard_tokens=200, separator=299)
    index = shards.read_index(spark, str(tmp_path)).orderBy("path").collect()
    want = [i % 7 for i in range(40) for _ in range(10 + i)]
    assert sum(r["documents"] for r in index) == 40 and sum(r["tokens"] for r in index) == len(want) + 40
    assert all(r["tokens"] >= 200 for r in index[:-1]) and index[0]["dtype"] == "uint16"
    tokens = [r["token"] for r in shards.read_tokens(spark, str(tmp_path), "train").orderBy("path", "pos").collect()]
    assert [t for t in tokens if t != 299] == want
    with pytest.raises(ValueError, match="another tokenizer"):
        shards.write_shards(docs, str(tmp_path), "val", 301, "abc")
    with pytest.raises(ValueError, match="exists"):
        shards.write_shards(docs, str(tmp_path), "train", 300, "abc")
    with pytest.raises(ValueError, match="quarantine"):
        shards.write_shards(docs, str(tmp_path), "x", 300, "abc", synthetic=True)
    stream = frame(spark, [(0, p, p * 3) for p in range(21)], "shard int, pos int, token int")
    got = shards.windows(stream, 5).orderBy("window").collect()
    assert len(got) == 4 and got[1]["x"] == [15, 18, 21, 24, 27] and got[1]["y"] == [18, 21, 24, 27, 30]
    assert shards.choose_dtype(65_536) == "uint16" and shards.choose_dtype(65_537) == "uint32"
    assert shards.sample_offsets([100, 3], 10, 2, 3, 0) == shards.sample_offsets([100, 3], 10, 2, 3, 0)


def test_shards_close_when_full(spark):
    """Against one document after the other, with empty and null sizes and a null split, in small batches."""
    rng = random.Random(8)
    rows = [(rng.choice(["a", "b", None]), i, rng.choice([0, 0, 1, 5, 9, 10, 11, 30, None])) for i in range(400)]
    want, state = {}, {}
    for split, i, n in rows:
        shard, held = state.get(split, (0, 0))
        if held >= 10:
            shard, held = shard + 1, 0
        want[i] = shard
        state[split] = (shard, held + (n or 0))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = shards.assign_shards(frame(spark, rows, "split string, doc_id long, n_tokens long"), 10).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r["doc_id"]: r["shard"] for r in got} == want


def test_batches(spark, tmp_path):
    """Windows of x and y as a loop over the files cuts them, for seeded and sequential batches."""
    root = str(tmp_path / "corpus")
    docs = frame(spark, [(i, [(i * 31 + k) % 90 for k in range(20 + i)]) for i in range(30)] + [(99, [1] * 4)], "doc_id long, ids array<int>")
    shards.write_shards(docs, root, "train", 100, "f", shard_tokens=300)
    shards.write_shards(docs.where("doc_id = 99"), root, "val", 100, "f")
    shards.write_shards(docs.where("doc_id = 3"), root, "train_b", 100, "f")
    index = shards.read_index(spark, root).where("split = 'train'").collect()
    assert [r["path"] for r in index] == [f"train_{i:03d}.bin" for i in range(len(index))] and len(index) > 2
    files_of = [np.fromfile(f"{root}/{r['path']}", "uint16") for r in index]
    seq = 16
    long = [t for t in files_of if len(t) > seq]
    lot = np.random.default_rng(5)
    sizes = np.array([len(t) for t in long])
    want = {}
    for step in range(7):
        picks = lot.choice(len(long), size=4, p=sizes / sizes.sum())
        for row, k in enumerate(picks):
            start = int(lot.integers(0, len(long[k]) - seq))
            window = long[k][start : start + seq + 1].tolist()
            want[step, row] = (window[:-1], window[1:])
    got = {(r["step"], r["row"]): (r["x"], r["y"]) for r in batches.seeded_batches(spark, root, "train", seq, 4, 7, 5).collect()}
    assert got == want
    got = batches.sequential_batches(spark, root, "train", seq, 3).orderBy("path", "batch", "row").collect()
    want = [t[w * seq : (w + 1) * seq + 1].tolist() for t in files_of for w in range((len(t) - 1) // seq)]
    assert [r["x"] for r in got] == [w[:-1] for w in want] and [r["y"] for r in got] == [w[1:] for w in want]
    assert max(r["row"] for r in got) == 2 and batches.throughput(spark, root, "train", seq, 4, 3)["tokens_per_sec"] > 0
    with pytest.raises(ValueError, match="the largest"):
        batches.seeded_batches(spark, root, "val", seq, 1, 1, 0)
    with pytest.raises(ValueError, match="no split"):
        batches.sequential_batches(spark, root, "test", seq, 1)


def test_reports(spark):
    rows = frame(spark, [(1, 1.0, 1.25, "done"), (2, 2.0, 2.75, "time exhausted")], "seed long, val double, test double, why string")
    got = {r["seed"]: (r["gap"], r["truncated"]) for r in reports.selection_bias(rows, "seed", "val", "test", "why").collect()}
    assert got == {1: (0.25, False), 2: (0.75, True), None: (0.5, True)}
    ends = reports.series_ends(frame(spark, [("a", 1, 0.5), ("a", 2, None), ("a", 3, 0.25), ("a", 2, 0.75), ("b", 1, None)], "k string, i int, v double"), "k", "i", "v")
    assert [tuple(r) for r in ends.collect()] == [("a", 0.5, 0.25, 0.75)]
    empty = reports.filter_summary(frame(spark, [(0, "input", 0, 0)], "at int, stage string, remaining long, removed long"), frame(spark, [], "reason string, documents long")).first()
    assert (empty["input"], empty["removed_fraction"], empty["rejections"]) == (0, 0.0, {})
    order = reports.sweep_regimes(frame(spark, [(1.1, None), (0.9, 50), (None, None), (0.9, 5)], "t double, k int"), F.col("t"), F.col("k")).collect()
    assert [r["regime"] for r in sorted(order)] == ["T0.9,k5", "T0.9,k50", "T1", "T1.1"]


def test_arrays_and_rendering(spark):
    one = frame(spark, [([1.0, -2.0, 3.0, 0.5], [2.0, 2.0, 2.0, 2.0], None, [1.0])], "a array<double>, b array<double>, n array<double>, s array<double>")
    a, b = F.col("a"), F.col("b")
    row = one.select(
        A.transpose(A.reshape(a, 2)).alias("t"), A.add(a, b).alias("sum"), A.power(a, b).alias("pow"), A.negative(a).alias("neg"), A.subtract(a, F.col("n")).alias("none"),
        A.along(A.reshape(a, 2), 0, A.mean).alias("means"), A.variance(F.array().cast("array<double>")).alias("empty"), render.shades(F.array(*map(F.lit, (0.0, 0.21, 0.99, 3.0)))).alias("heat"),
        render.painted(F.lit("a b"), F.lit(5.0)).alias("paint"), render.painted(F.lit("a b"), F.lit(5.0), False).alias("plain"), render.cell(F.lit(7), 4).alias("cell"),
        render.cell(F.lit(None).cast("string"), 3, False).alias("gap"),
    ).first()
    assert row["t"] == [[1.0, 3.0], [-2.0, 0.5]] and row["sum"] == [3.0, 0.0, 5.0, 2.5] and row["pow"] == [1.0, 4.0, 9.0, 0.25] and row["none"] is None
    assert row["means"] == [2.0, -0.75] and row["empty"] is None and row["heat"] == " ░██" and row["neg"] == [-1.0, 2.0, -3.0, -0.5]
    assert (row["paint"], row["plain"], row["cell"], row["gap"]) == ("\033[38;5;220ma·b\033[0m", "a·b", "   7", "-  ")
    for bad in (A.add(a, F.col("s")), A.reshape(a, 3)):
        with pytest.raises(Exception, match="different lengths|a rest"):
            one.select(bad).collect()
    times = ["2026-03-01T00:00:00+00:00", "2026-03-01 01:02:03", "2026-03-01T02:00:00Z", "2026-03-01T00:00:00.5+02:00", "no", None, "2026-03-01"]
    got = [r[0] for r in frame(spark, [(t,) for t in times], "t string").select(T.stamp(T.instant(F.col("t")))).collect()]
    assert got == ["20260301-000000", "20260301-010203", "20260301-020000", "20260228-220000", None, None, "20260301-000000"]


def test_suite_and_guard(spark):
    rows = frame(spark, [(True, 1.0, 1.0, ["/w/x"], 0), (None, 1.2, 1.0, ["/w/../etc"], 2)], "ok boolean, c double, i double, p array<string>, u long")
    suite = gates.default_suite(0.01, ("/w",), intact=F.col("ok"), candidate=F.col("c"), incumbent=F.col("i"), paths=F.col("p"), untagged=F.col("u"))
    good, bad = [r[0] for r in rows.select(gates.report(suite)).collect()]
    assert all(r["passed"] for r in good) and [r["passed"] for r in bad] == [False, False, False, False, True]
    assert bad[1]["message"] == "candidate 1.2000, incumbent 1.0000" and bad[3]["message"].startswith("2 synthetic")
    paths = frame(spark, [(["/w/./a//b"],), (["/w/a/../../w/b"],), (["w/a"],), (["/../w/a"],), (["/wx"],), ([None],)], "p array<string>")
    assert [r[0] for r in paths.select(gates.writes_confined(F.col("p"), ["/w"])).collect()] == [True, True, False, False, False, False]
    with guard.deny_network():
        with pytest.raises(guard.NetworkDenied):
            socket.create_connection(("192.0.2.1", 9), 0.1)
        assert spark.range(3).count() == 3
    assert bpe.CharTokenizer(["a"]).fingerprint() != bpe.CharTokenizer(["b"]).fingerprint()


def test_budget_and_arms(spark, tmp_path):
    (tmp_path / "x").write_bytes(b"a" * 100)
    budget = logs.Budget(batches=3, disk_bytes=100, disk_path=str(tmp_path))
    assert budget.spent(0, 0.0) == "disk exhausted" and budget.remaining(5, 0.0) == {"batches": 0, "seconds": None, "disk_bytes": 0}
    (tmp_path / "halt").write_text("operator\n")
    assert logs.Budget(halt_file=str(tmp_path / "halt")).spent(0, 0.0) == "operator"
    docs = frame(spark, [(i,) for i in range(500)], "doc_id long")
    with pytest.raises(ValueError, match="no arm"):
        arms.corpus("other", docs, [])
    keyed = docs.select(F.sha2(F.col("doc_id").cast("string"), 256).alias("_key"))
    ordered = sorted(r[0] for r in keyed.collect())
    for few in (10_000, 2):
        arms.FEW = few
        assert [arms.smallest_key(keyed, k) for k in (0, 1, 250, 500)] == [None, ordered[0], ordered[249], ordered[499]]
    arms.FEW = 10_000


def test_run_index(spark, tmp_path):
    for name, bpb, seed in (("nf-s0", 1.90, 0), ("nf-s1", 1.88, 1), ("nf-s2", 1.92, 2), ("other", 1.50, 0)):
        run = tmp_path / f"20260101-000000-{name}"
        (run / "checkpoints").mkdir(parents=True)
        (run / "config.yaml").write_text(json.dumps({"model": {"d_model": 8}, "training": {"name": name, "seed": seed}}))
        (run / "manifest.json").write_text(json.dumps({"git": {"sha": "x", "dirty": True}, "started_at": "t"}))
        (run / "checkpoints" / "best.json").write_text(json.dumps({"step": 2, "val_bpb": bpb, "val_loss": 1.0}))
        (run / "metrics.jsonl").write_text('{"step": 1, "loss": 2.0, "ok": true}\n\n{"step": 2, "loss": 1.5, "elapsed": 3.5}\n')
    (tmp_path / "empty").mkdir()
    odd = tmp_path / "20260102-000000-odd-one"
    (odd / "checkpoints").mkdir(parents=True)
    (odd / "config.yaml").write_text("{not json")
    (odd / "manifest.json").write_text(json.dumps({"other": 1, "parameters": {"total": 12}}))
    (odd / "checkpoints" / "best.json").write_text(json.dumps({"step": 2, "rung": "v6"}))
    lines = [{"step": 1, "loss": 3, "tokens_per_sec": 7.0, "elapsed": 1}, {"step": 2, "loss": 2.5, "note": "5", "flag": False}, {"step": 3, "val": 1.5, "elapsed": 99, "tokens_per_sec": 1}]
    (odd / "metrics.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\nbroken\n")
    third = tmp_path / "20260103-000000-x"
    third.mkdir()
    (third / "config.yaml").write_text(json.dumps({"model": {"seq_len": 0}, "training": {"name": "", "seq_len": 64, "rung": "v5"}}))
    found, metrics = runs.build_index(spark, str(tmp_path))
    assert found.count() == 6 and metrics.where("run_id like '%nf%' or run_id like '%other%'").count() == 16
    first = found.where("name = 'nf-s0'").first()
    assert (first["final_train_loss"], first["wall_clock"], first["git_dirty"], first["best_step"]) == (1.5, 3.5, 1, 2)
    row = found.where("name = 'odd-one'").first()
    assert (row["final_train_loss"], row["tokens_per_sec"], row["wall_clock"], row["rung"], row["params_total"], row["git_dirty"]) == (2.5, 7.0, 1.0, "v6", 12, 0)
    keys = {(r["step"], r["key"], r["value"]) for r in metrics.where("run_id like '%odd%'").collect()}
    assert keys == {(1, "loss", 3), (1, "tokens_per_sec", 7), (1, "elapsed", 1), (2, "loss", 2.5), (2, "flag", 0), (3, "val", 1.5), (3, "elapsed", 99), (3, "tokens_per_sec", 1)}
    row = found.where("name = 'x'").first()
    assert row["seq_len"] == 64 and row["rung"] == "v5" and runs.latest_run(found).first()["name"] == "x"
    runs.register({"runs": found})
    assert spark.sql("select count(*) n from runs").first()["n"] == 6
    assert [r["label"] for r in runs.comparison_table(runs.seed_groups(found)).collect()] == ["other", "nf"]
    found = found.where("best_bpb is not null")
    groups = {r["label"]: r for r in runs.seed_groups(found).collect()}
    assert groups["nf"]["n"] == 3 and abs(groups["nf"]["std"] - 0.02) < 1e-12 and groups["other"]["std"] == 0
    assert abs(runs.noise_floor(runs.seed_groups(found, name_like="NF%")).first()["floor"] - 0.02) < 1e-12
    assert runs.leaderboard(found, limit=1).first()["name"] == "other"
    pair = expstats.compare(expstats.pair_up(runs.seed_groups(found), "nf", "other")).first()
    assert pair["winner"] == "other" and pair["verdict"] == "underpowered"
    with pytest.raises(Exception, match="no group"):
        expstats.pair_up(runs.seed_groups(found), "nf", "absent").collect()


def test_whole_groups_are_compared(spark, tmp_path):
    """Every run of a rung counts, whatever its seed: p-values against all splits, and with too many of them near it."""
    rng = random.Random(4)
    groups = {"a": [rng.random() for _ in range(6)], "b": [rng.random() + 0.5 for _ in range(3)], "c": [rng.random() + 0.2 for _ in range(14)]}
    rows = [(f"{r}-s{i}", r, i if i != 2 else None, v) for r, values in groups.items() for i, v in enumerate(values)] + [("a-s9", "a", 9, None), ("x", None, 1, 0.5)]
    frame(spark, rows, "name string, rung string, seed long, best_bpb double").write.parquet(str(tmp_path / "runs.parquet"))
    got = {(r["label_a"], r["label_b"]): r for r in experiment_queries.permutation_whole(spark, str(tmp_path)).collect()}
    assert set(got) == {("a", "b"), ("a", "c"), ("b", "c")}
    for (x, y), row in got.items():
        pooled, k = groups[x] + groups[y], len(groups[x])
        gaps = [abs(sum(c) / k - (sum(pooled) - sum(c)) / (len(pooled) - k)) for c in itertools.combinations(pooled, k)]
        p = sum(g >= gaps[0] - 1e-12 for g in gaps) / len(gaps)
        assert abs(row["p_value"] - p) < (2e-6 if len(gaps) <= expstats.MAX_EXACT else 0.02)
        assert abs(row["min_p"] - 2 / len(gaps)) < 1e-6
    difference = {(r["label_a"], r["label_b"]): r["difference"] for r in experiment_queries.verdicts_whole(spark, str(tmp_path)).collect()}
    assert all(abs(d - (sum(groups[y]) / len(groups[y]) - sum(groups[x]) / len(groups[x]))) < 1e-6 for (x, y), d in difference.items())


def many_runs(spark, folder, sizes=(8000, 8100, 7900), shifts=(0, 0.005, 0.3), spread=0.2):
    """Rungs a, b and c of thousands of runs, as a table; their values."""
    rng = random.Random(5)
    groups = {r: [rng.gauss(2 + shift, spread) for _ in range(n)] for r, n, shift in zip("abc", sizes, shifts, strict=True)}
    rows = [(f"{r}-s{i}", r, i % 5, v) for r, values in groups.items() for i, v in enumerate(values)]
    frame(spark, rows, "name string, rung string, seed long, best_bpb double").write.parquet(f"{folder}/runs.parquet")
    return groups


def test_large_groups_are_split_in_time(spark, tmp_path):
    """All runs and 20,000 random splits also of groups whose shuffles take minutes (this test ran 300 s with them, session included)."""
    groups, began = many_runs(spark, tmp_path), time.monotonic()
    got = {(r["label_a"], r["label_b"]): r["p_value"] for r in experiment_queries.permutation_whole(spark, str(tmp_path)).collect()}
    assert time.monotonic() - began < 60 and set(got) == {("a", "b"), ("a", "c"), ("b", "c")}
    for (x, y), p in got.items():
        gap = statistics.fmean(groups[x]) - statistics.fmean(groups[y])
        error = statistics.stdev(groups[x] + groups[y]) * (1 / len(groups[x]) + 1 / len(groups[y])) ** 0.5
        assert abs(p - math.erfc(abs(gap) / error / 2**0.5)) < 0.015
    assert 0.02 < got["a", "b"] < 0.98 and got["b", "c"] == 0


def test_verdicts_on_large_groups_in_time(spark, tmp_path):
    """Effects, winners and verdicts over all runs, beside a group of two runs (206 s by shuffles)."""
    groups, began = many_runs(spark, tmp_path, (8000, 8100, 2), (0, 0.3, 0.3)), time.monotonic()
    got = {(r["label_a"], r["label_b"]): r for r in experiment_queries.verdicts_whole(spark, str(tmp_path)).collect()}
    assert time.monotonic() - began < 60 and set(got) == {("a", "b"), ("a", "c"), ("b", "c")}
    for (x, y), row in got.items():
        gap, most = statistics.fmean(groups[y]) - statistics.fmean(groups[x]), max(statistics.stdev(groups[x]), statistics.stdev(groups[y]))
        assert abs(row["difference"] - gap) < 2e-6 and abs(row["effect"] - abs(gap) / most) < 2e-6 and row["winner"] == (x if gap > 0 else y)
    assert [got[k]["verdict"] for k in (("a", "b"), ("a", "c"), ("b", "c"))] == ["better", "not significant", "below the noise floor"]


def test_random_masks_are_sets_of_equal_chance():
    for total, size in ((10, 5), (9, 2), (8, 4), (66, 2), (11, 1), (70, 69)):
        masks = expstats._masks(np.random.default_rng(1), total, size, 100_000)
        bits = np.unpackbits(masks, axis=1, bitorder="little")
        assert (bits.sum(1) == size).all() and not bits[:, total:].any()
        found, sets = Counter(map(bytes, masks)), math.comb(total, size)
        each = 100_000 / sets
        assert len(found) == sets and abs(sum((n - each) ** 2 / each for n in found.values()) - (sets - 1)) < 4 * (2 * sets) ** 0.5
    for total, size in ((5000, 2500), (5000, 2), (5001, 40), (4999, 1700)):
        assert (np.unpackbits(expstats._masks(np.random.default_rng(2), total, size, 300), axis=1).sum(1) == size).all()


def test_splits_are_those_of_shuffles():
    """Draw by draw what the reference's seeded shuffles give."""
    for total, first in ((30, 12), (65, 64), (257, 100)):
        lot, deck = random.Random(0), list(range(total))
        for row in expstats._splits(total, first, 50):
            lot.shuffle(deck)
            assert row.tolist() == deck[:first]


def test_masks_and_shuffles_agree(monkeypatch):
    """A test by masks is near that by shuffles; values that are no numbers or infinite count alike."""
    rng = random.Random(7)
    few = lambda n, more: [rng.random() + more for _ in range(n)]
    cases = [(few(30, 0), few(50, 0.1)), (few(200, 0.02), few(90, 0)), (few(5, 0.4), few(500, 0)), ([1.0] * 40, [1.0] * 60), (few(40, 0) + [math.inf], few(60, 0)), (few(40, 0), few(60, 0) + [math.nan])]
    by_shuffles = [expstats.permutation_p(a, b) for a, b in cases]
    monkeypatch.setattr(expstats, "SHUFFLED", 0)
    monkeypatch.setattr(expstats, "HELD", 10_000)
    monkeypatch.setattr(expstats, "GROUPS", 3)
    by_masks = [expstats.permutation_p(a, b) for a, b in cases]
    assert all(abs(p - q) < 0.02 for p, q in zip(by_shuffles, by_masks, strict=True)) and by_masks[3] == 1 and by_masks[5] == 0
    assert [expstats.permutation_p(a, b) for a, b in cases] == by_masks
    assert expstats.permutation_p([1, 2, 3, 4, 5], [11, 12, 13, 14, 15]) == 2 / 252


def test_sweep_has_all_sizes(spark, tmp_path):
    """The reference's six sizes; a larger vocabulary needs no more tokens."""
    rng = random.Random(6)
    text = " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(3000))
    frame(spark, [(i, text[i * 40 :]) for i in range(2)] + [(9, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = sorted(experiment_queries.vocabulary_sweep(spark, str(tmp_path)).collect())
    assert [r["vocab_size"] for r in found] == [256, 512, 1024, 2048, 4096, 8192]
    tokens = [r["tokens"] for r in found]
    assert tokens[0] == found[0]["bytes"] and tokens == sorted(tokens, reverse=True) and tokens[2] > tokens[3] > tokens[4]


def test_permutation_against_all_splits(spark):
    rng = random.Random(3)
    cases = [([rng.random() for _ in range(n)], [rng.random() + 0.3 for _ in range(m)]) for n, m in ((3, 3), (5, 5), (1, 6), (0, 3), (2, 2))] + [(None, [1.0])]
    got = frame(spark, cases, "a array<double>, b array<double>").select(expstats.permutation_test("a", "b")).collect()
    for (p,), (a, b) in zip(got, cases, strict=True):
        if not a:
            assert p == 1
            continue
        pooled, k = a + b, len(a)
        gaps = [abs(sum(c) / k - (sum(pooled) - sum(c)) / (len(pooled) - k)) for c in itertools.combinations(pooled, k)]
        assert abs(p - sum(g >= gaps[0] - 1e-12 for g in gaps) / len(gaps)) < 1e-12
    assert expstats.permutation_p([1, 2, 3, 4, 5], [11, 12, 13, 14, 15]) == 2 / 252
    assert expstats.permutation_p([0.0] * 12, [1.0] * 12, 100) == 0


def test_lineage_and_gates(spark):
    chain = []
    for i in range(5):
        chain.append(lineage.append(chain, {"b": i, "a": "é"}))
    rows = [("c", e["index"], e["prev"], e["digest"], e["payload"]) for e in chain]
    schema = "chain string, index long, prev string, digest string, payload string"
    assert lineage.verify(frame(spark, rows, schema), "chain").first()["intact"]
    bad = [r if r[1] != 3 else (*r[:4], "{}") for r in rows]
    assert tuple(lineage.verify(frame(spark, bad, schema), "chain").first())[2:] == (False, 3, "digest")
    assert tuple(lineage.verify(frame(spark, rows[:2] + rows[3:], schema), "chain").first())[2:] == (False, 2, "index")
    g = frame(spark, [(1.0, 1.005, ["/w/a"]), (1.1, 1.0, ["/w/../x"]), (None, 1.0, None)], "c double, i double, p array<string>")
    checks = {"r": gates.no_regression(F.col("c"), F.col("i")), "w": gates.writes_confined(F.col("p"), ["/w"])}
    assert [tuple(r[0]) for r in g.select(gates.gate(checks)).collect()] == [(True, []), (False, ["r", "w"]), (False, ["r", "w"])]
    with pytest.raises(ValueError):
        gates.gate({})


def test_parameter_counts(spark):
    """The totals that a built model of each rung has, worked out by hand for one width."""
    d, layers, v, length = 6, 2, 10, 5
    models = frame(spark, [(r, d, layers, v, length) for r in tasks.RUNGS], "rung string, d_model long, n_layer long, vocab_size long, seq_len long")
    got = {r["rung"]: r for r in tasks.parameter_counts(tasks.with_rungs(models)).collect()}
    gelu = 4 * d * d + 4 * d + 2 * d * 24 + 24 + d
    assert got["v2_gpt2"]["total"] == (v + length) * d + layers * (4 * d + gelu) + 2 * d + v * d
    assert got["v4_rope"]["total"] == v * d + layers * (2 * d + gelu) + d + v * d
    assert got["v6_modern"]["total"] == v * d + layers * (2 * d + 4 * d * d + 3 * d * 16) + d and got["v6_modern"]["embedding"] == v * d
    assert got["v5_swiglu"]["per_layer"] == 2 * d + 4 * d * d + 4 * d + 3 * d * 16 + 2 * 16 + d
    costs = tasks.embedding_costs(frame(spark, [(256,), (512,), (2048,)], "vocab_size long"), 8).orderBy("vocab_size").collect()
    assert [r["added"] for r in costs] == [2048, 2048, 12288]


def test_general_numbers(spark):
    values = [0.0, 1.0, 0.7, 1e-7, 123456.0, 1234567.0, 0.0001, 0.00001, -2.5, 999999.5, 1e300, 0.1 + 0.2, 100000.0, float("inf"), float("nan"), 12345.6]
    got = frame(spark, [(v,) for v in values], "v double").select(T.general(F.col("v"))).collect()
    assert [r[0] for r in got] == ["%g" % v for v in values]


def test_checkpoint_folder():
    assert session.checkpoint_folder("/shared", "spark://x") == "/shared" and session.checkpoint_folder(None, "local[4]")
    for master in ("spark://x:7077", "local-cluster[2,1,1024]", "yarn"):
        with pytest.raises(ValueError, match="checkpoint"):
            session.checkpoint_folder(None, master)


def test_logit_metrics(spark):
    rows = frame(spark, [(0, [1.0, 2.0, 3.0, 3.0], 2), (1, [1000.0, 0.0, 0.0, 0.0], 1)], "i int, l array<double>, t int")
    got = logits.predictions(rows, "l", "t", 2).orderBy("i").collect()
    z = sum(math.exp(x) for x in (1, 2, 3, 3))
    assert abs(got[0]["surprisal"] + math.log2(math.exp(3) / z)) < 1e-9 and got[0]["rank"] == 1
    assert [p["token"] for p in got[0]["top"]] == [2, 3] and got[1]["rank"] == 2 and got[1]["confident_and_wrong"]
    d = frame(spark, [([7] * 100,), (list(range(100)),), ([1],)], "s array<int>").select(logits.diversity_of_arrays(F.col("s"), 100).alias("d")).collect()
    assert [r["d"]["distinct_2"] for r in d] == [1 / 99, 1.0, 0.0]


def test_arms_and_tasks(spark):
    docs = frame(spark, [(i, f"t{i}") for i in range(100)], "doc_id long, text string")
    small, large = ({r[0] for r in arms.hash_sample(docs, f).collect()} for f in (0.25, 0.5))
    assert len(small) == 25 and len(large) == 50 and small < large
    assert arms.anchor(docs, [docs], 0.3).count() == 100
    with pytest.raises(ValueError):
        arms.anchor(docs, [docs], 1.5)
    assert tasks.search_grid(spark).count() == 18 == tasks.grid_size()
    with pytest.raises(ValueError, match="leave less"):
        tasks.search_grid(spark, tasks.GRID | {"synthetic_fraction": [0.0, 0.9]})
    drawn = tasks.sample_proposals(spark, 500)
    assert drawn.join(tasks.valid_proposals(drawn, tasks.search_grid(spark)), "proposal_id", "left_semi").count() == 500
    assert drawn.select("temperature").distinct().count() == 3
    for name in tasks.TASKS:
        assert tasks.examples(spark, name, 20).collect() == tasks.examples(spark, name, 20).collect()
    made = {name: tasks.examples(spark, name, 50).collect() for name in tasks.TASKS}
    for r in made["copy"]:
        assert r["prompt"] == r["answer"].strip() + " | " and len(r["answer"].split()) == 8
    for r in made["sort"]:
        assert sorted(map(int, r["prompt"].removesuffix(" -> ").split())) == list(map(int, r["answer"].split()))
    for r in made["modular_arithmetic"] + tasks.examples(spark, "modular_arithmetic", 50, operation="*").collect():
        a, operation, b, _, m, _ = r["prompt"].split()
        assert r["answer"] == f"{(int(a) + int(b) if operation == '+' else int(a) * int(b)) % int(m)}\n"
    for r in made["dyck"]:
        text, depth = r["prompt"].strip() + r["answer"].strip(), 0
        assert r["prompt"].endswith(" ") and len(r["prompt"]) == 13
        while (shorter := text.replace("()", "").replace("[]", "").replace("{}", "")) != text:
            text = shorter
        assert text == ""
    got = frame(spark, [("abcd", "abxd"), ("ab", "ab"), ("", "")], "answer string, output string")
    assert [(r["exact"], r["prefix_agreement"]) for r in tasks.score(got).collect()] == [(False, 0.5), (True, 1.0), (True, 1.0)]


def test_eav_edge_cases(spark):
    keys = frame(spark, [("loss", "double"), ("tokens", "bigint"), ("ok", "boolean"), ("loss", "double")], "column_name string, value_type string")
    columns = eav.attribute_columns(keys)
    inf, nan = float("inf"), float("nan")
    rows = [
        ("r", 1, "Loss", 1.0, 1), ("r", 1, "LOSS", 2.0, 2), ("r", 1, "tokens", 3.5, 1), ("r", 1, "o-k", 1.0, 1), ("r", 1, "other", 9.0, 1),
        ("r", None, "loss", 5.0, 1), ("r", None, "loss", 6.0, 1), ("r", 2, "loss", nan, 3), ("r", 2, "loss", 4.0, 1), ("r", 3, None, 1.0, 1),
        (None, 1, "tokens", 7.0, 1), ("s", 1, "ok", 2.0, 1), ("s", 1, "tokens", inf, 1), ("s", 2, "loss", None, 1), ("s", 2, "loss", 1.0, 1), ("s", 2, "loss", 1.0, 1),
    ]
    long = frame(spark, [(*r, "x") for r in rows], "run_id string, step long, key string, value double, logged_at int, loss string")
    wide = eav.widen(long, columns)
    got = {(r["run_id"], r["step"]): (r["loss"], r["ok"], r["tokens"], r["conflicts"], r["rejected"]) for r in wide.collect()}
    assert got[("r", 1)] == (2.0, True, None, [0], [2]) and got[("r", None)] == (6.0, None, None, [0], [])
    assert got[("r", 2)] == (4.0, None, None, [], []) and got[("r", 3)] == (None, None, None, [], [])
    assert got[(None, 1)] == (None, None, 7, [], []) and got[("s", 1)] == (None, None, None, [], [1, 2]) and got[("s", 2)] == (1.0, None, None, [], [])
    assert {tuple(r) for r in eav.contradictions(wide, columns).collect()} == {("r", 1, "loss")}
    assert eav.widen(long.limit(0), columns).count() == 0 and eav.widen(long, []).count() == len(got)
    with pytest.raises(ValueError, match="spelling"):
        eav.attribute_columns(frame(spark, [("a_b", "double"), ("ab", "double")], "column_name string, value_type string"))


def test_eav_many_batches(spark):
    long = spark.range(60_000).selectExpr("cast(id % 3 as string) run_id", "id div 6 step", "array('loss','tokens')[int(id div 3 % 2)] key", "double(id) value", "1 logged_at")
    columns = [("loss", "double"), ("tokens", "bigint")]
    wide = eav.widen(long, columns)
    assert wide.count() == 30_000 and wide.where("loss is null or tokens is null").count() == 0
    assert wide.agg(F.sum(F.col("loss") + F.col("tokens"))).first()[0] == 60_000 * 59_999 / 2


def test_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"one\n\n two \n\n\n\nthree")
    (tmp_path / "b.txt").write_bytes(b"x\xff<|endoftext|>\n\n<|endoftext|> y\n\nz")
    docs = files.split_into_documents(files.read_raw(spark, str(tmp_path / "*.txt"))).orderBy("path", "ord").collect()
    assert [r["text"] for r in docs] == ["one", "two", "three", "x�", "y\n\nz"]
    source = {"name": "a", "url": (tmp_path / "a.txt").as_uri(), "sha256": None, "expected_bytes": None}
    target = files.fetch(source, str(tmp_path / "raw"))
    assert files.read_manifest(spark, str(tmp_path / "raw" / "MANIFEST.json")).first()["actual_bytes"] == target.stat().st_size
    with pytest.raises(ValueError, match="digest"):
        files.fetch({**source, "name": "b", "sha256": "0" * 64}, str(tmp_path / "raw"))
    assert not list((tmp_path / "raw").glob("*.partial"))
    assert files.fetch(source, str(tmp_path / "raw")) == target
    target.write_bytes(b"other")
    with pytest.raises(ValueError, match="known is"):
        files.fetch(source, str(tmp_path / "raw"))
    usage = {r["folder"] and r["folder"].rsplit("/", 1)[-1]: (r["files"], r["bytes"]) for r in files.disk_usage(spark, str(tmp_path)).collect()}
    assert usage["raw"] == (2, 5 + (tmp_path / "raw" / "MANIFEST.json").stat().st_size) and usage[None][0] == 4
    for step in (2, 10, 9):
        files.save_checkpoint(frame(spark, [("w", [1.0 * step])], "name string, values array<double>"), str(tmp_path / "ck"), step, keep=2)
    assert {r["step"] for r in files.checkpoints(spark, str(tmp_path / "ck")).collect()} == {9, 10}
    assert files.load_checkpoint(spark, str(tmp_path / "ck")).first()["values"] == [10.0] and files.load_checkpoint(spark, str(tmp_path / "ck"), 9).first()["values"] == [9.0]
    with pytest.raises(Exception, match="exists"):
        files.save_checkpoint(frame(spark, [("w", [1.0])], "name string, values array<double>"), str(tmp_path / "ck"), 9)
    files.write_evaluation(frame(spark, [(1.5,)], "loss double"), str(tmp_path / "eval.json"))
    assert files.read_json_lines(spark, str(tmp_path / "eval.json"), "loss double").first()["loss"] == 1.5
    steps = frame(spark, [("step-9",), ("step-10",), ("step-2",), ("best",)], "name string")
    assert {r["name"] for r in files.rotate(steps, 1).collect()} == {"step-9", "step-2"}


def test_streams(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    for i in range(3):
        (log / f"{i}.json").write_text(json.dumps({"step": i, "loss": 1.0}) + "\n")
    schema, out, state = "step bigint, loss double", str(tmp_path / "out"), str(tmp_path / "state")
    logs.copy_to(logs.log_stream(spark, str(log), schema), out, state).awaitTermination()
    (log / "9.json").write_text('{"step": 9}\n')
    logs.copy_to(logs.log_stream(spark, str(log), schema), out, state).awaitTermination()
    assert sorted(r["step"] for r in spark.read.parquet(out).collect()) == [0, 1, 2, 9]
    seen = []
    stream = logs.log_stream(spark, str(log), schema, files_per_batch=1)
    handle = lambda f, n: seen.extend(r["step"] for r in f.collect())
    assert logs.run_bounded(stream, handle, str(tmp_path / "s2"), logs.Budget(batches=2)) == "batches exhausted"
    assert len(seen) == 2
    assert logs.run_bounded(stream, handle, str(tmp_path / "s2"), logs.Budget()) == "finished" and sorted(seen) == [0, 1, 2, 9]


def test_induction(spark):
    blocks = logits.repeated_blocks(3, 4, [5, 6, 7], seed=1)
    assert len(blocks) == 3 and all(b[:4] == b[4:] for b in blocks) and blocks == logits.repeated_blocks(3, 4, [5, 6, 7], seed=1)
    rows = [(t, p, 4.0 if p < 4 else 1.0 + t) for t in range(2) for p in range(7)]
    got = logits.induction(frame(spark, rows, "trial int, position int, bits double"), 4, 8).first()
    assert tuple(got) == (4.0, 1.5, 2.5, 1.5, 3.0)
    docs = frame(spark, [(0, "é", [1, 2, 3]), (1, "ab", [4])], "i int, text string, ids array<int>")
    assert tuple(logits.generated_stats(docs, docs).first()) == (2, 4, 4, 2.0)

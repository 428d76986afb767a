import itertools
import math
import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import regex
from pyspark.sql import functions as F

from taleloom.llm import encode, mixing, near, overlap, packing, postings, quality, residue, suffixes
from taleloom.llm.words import sequences, words

SMALL = "/root/testdata/sf0.01"
ODD = ["", " ", "naïve café", "日本語", "👨‍👩‍👧", "a\0b", "don't", "a" * 5000, "\x1c \x85x", "<|endoftext|>", " \n\n x", "ſ’s"]


def docs(spark, rows, extra="split string, source string"):
    return spark.createDataFrame(rows, "doc_id long, text string, " + extra)


def brute_grams(text, n):
    w = regex.findall(r"[\p{L}\p{N}]+", (text or "").lower())
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= 20 else set()


def story(rng, n):
    return " ".join(rng.choice(["fox", "hen", "oak", "sun", "sea", "red", "old", "ran", "sat", "saw", "day", "İstanbul", "été"]) + str(rng.randrange(40)) for _ in range(n))


def family(seed=1):
    """Texts with copies, edits, insertions, hot boilerplate and dirt."""
    rng = random.Random(seed)
    plate = story(rng, 25)
    rows = []
    for i in range(160):
        text = story(rng, rng.choice([19, 20, 24, 60, 120]))
        if i % 3 == 0:
            text = plate + ". " + text
        rows.append(text)
    for i in range(80):
        w = rows[i].split()
        for _ in range(rng.randrange(6)):
            w[rng.randrange(len(w))] = "edit" + str(rng.randrange(9))
        rows.append(rng.choice([" ", "\n"]).join(w).upper() if i % 2 else " ".join(w + story(rng, rng.randrange(30)).split()))
    rows += rows[:30] + [None, "", "  ", "one", plate, plate]
    splits = ["train", "Train ", " val", "TEST", None, "validation", "other", "train", "train"]
    return [(i, t, rng.choice(splits), rng.choice(["a", "b", None])) for i, t in enumerate(rows)]


def test_words_and_sequences():
    for text in ["Hello, World_2 x", "İIß ſ", "été 12½", "a-b_c", "", None]:
        assert words(text) == regex.findall(r"[\p{L}\p{N}]+", (text or "").lower())
    at, grams, starts = sequences(["a b c d a b c d", "x", None, "a b c"], 3, 3)
    assert at.tolist() == [0, 3] and (starts[1:] - starts[:-1]).tolist() == [4, 1] and grams[-1] in grams[:4]


@pytest.mark.parametrize(("seed", "buckets", "ranges"), [(1, 8, 16_384), (2, 3000, 16_384), (3, 400, 20)])
def test_overlap_against_brute_force(spark, monkeypatch, seed, buckets, ranges):
    """With few buckets of many suffixes, with many so that repeated passages are large runs, and with divided ranges."""
    monkeypatch.setattr(postings, "bucket_count", lambda source, size=None: buckets)
    monkeypatch.setattr(postings, "MOST_TASKS", 8)
    monkeypatch.setattr(suffixes, "MOST_RANGES", ranges)
    rows = family(seed)
    side = {i: next((s for s in ("train", "val", "test") if (sp or "").strip().lower().startswith(s)), None) for i, _, sp, _ in rows}
    grams = {i: brute_grams(t, 8) for i, t, _, _ in rows}
    want = {
        (e, t) for e in grams for t in grams
        if side[e] in ("val", "test") and side[t] == "train" and grams[e] and len(grams[e] & grams[t]) >= 0.5 * len(grams[e])
    }
    got = overlap.record_pairs(docs(spark, rows))
    assert {(r["eval_id"], r["train_id"]) for r in got.collect()} == want and len(want) > 10
    assert overlap.report(got).agg(F.sum("pairs")).first()[0] == len(want)
    assert overlap.record_pairs(docs(spark, [])).count() == 0


def test_suffixes_are_sorted_words():
    texts = [story(random.Random(i), 60) for i in range(4)] + ["a b c d e f g h " * 4, "too short", None]
    at, size, key, place = suffixes.suffixes(texts, 20)
    assert at.tolist() == [0, 1, 2, 3, 4] and size.tolist() == [len(words(t)) - 7 for t in texts[:4]] + [8] and place[-8:].tolist() == list(range(8))
    order = np.argsort(key)
    prefix = suffixes.common_prefix(key[order][:-1], key[order][1:], 20)
    classes = [tuple(int(k) >> 20 + 4 * (7 - i) & 15 for i in range(8)) for k in key[order]]
    assert classes == sorted(classes)
    assert prefix.tolist() == [next((i for i in range(8) if a[i] != b[i]), 7 if x != y else 8) for (a, b), (x, y) in zip(itertools.pairwise(classes), itertools.pairwise(key[order].tolist()))]
    ranges = suffixes.cut_ranges(np.r_[np.arange(1000, dtype=np.uint64), np.full(600, 7, np.uint64)], 8, 16, 2)
    assert ranges.large.tolist() == [7] and ranges.spread[0] >= 12 and ranges.buckets == ranges.plain + ranges.spread[0]
    bucket = ranges.bucket_of(np.full(100, 7, np.uint64), np.arange(100, dtype=np.uint64))
    assert len(set(bucket.tolist())) == ranges.spread[0] and all(ranges.run_of(b) == 0 for b in bucket.tolist()) and ranges.run_of(3) == -1
    empty = suffixes.cut_ranges(np.zeros(0, np.uint64), 8, 16, 1)
    assert empty.bucket_of(np.arange(3, dtype=np.uint64), np.arange(3, dtype=np.uint64)).tolist() == [0, 0, 0]


def test_spans_and_coverage():
    """Record 1 has 5 of 9 sequences in two spans and probes with its rarest one; record 2 has too few."""
    rows = {"e": [1] * 5 + [2], "place": [0, 1, 2, 7, 8, 4], "n": [9] * 6, "df": [5, 4, 1, 3, 9, 1], "key": [7] * 6}
    first, length = overlap.spans(np.array(rows["e"]), np.array(rows["place"]))
    assert first.tolist() == [0, 3, 5] and length.tolist() == [10, 9, 8]
    table = pa.table(rows)
    assert overlap.probing(table, 0.5).tolist() == [2] and sorted(overlap.probing(table, 0.3).tolist()) == [1, 2, 3]


def test_buckets_of_any_input(spark):
    """An input that is no plain scan is measured by its texts, and buckets have an upper bound."""
    frame = docs(spark, [(i, "x" * 1000, None, None) for i in range(50)])
    assert postings.stored_bytes(frame) == 20_000 and postings.bucket_count(frame) == 8
    assert postings.bucket_count(frame, 1 << 62) == postings.MOST_BUCKETS


@pytest.mark.parametrize(("size", "threshold"), [(3, 0.7), (5, 0.8)])
def test_near_against_brute_force(spark, size, threshold):
    rows = family(3)
    grams = {i: brute_grams(t, size) for i, t, _, _ in rows if brute_grams(t, size)}
    want = {(a, b) for a, b in itertools.combinations(sorted(grams), 2) if len(grams[a] & grams[b]) >= threshold * len(grams[a] | grams[b])}
    frame = docs(spark, rows)
    assert {tuple(r) for r in near.record_pairs(frame, size, threshold).collect()} == want and len(want) > 30
    links = {r["doc_id"]: r["links"] for r in near.groups(frame, size, threshold).collect()}
    assert links == {i: sum(i in p for p in want) for i in grams if any(i in p for p in want)}
    assert near.record_pairs(docs(spark, []), size, threshold).count() == 0


def test_sketch_merges_and_estimates():
    texts = [" ".join(f"w{i}" for i in range(a, b)) for a, b in ((0, 400), (100, 500), (0, 500), (0, 30))]
    _, hashes, starts = sequences(texts, 1)
    sketch = near.registers(hashes, starts)
    assert (near.merge(sketch[0], sketch[1]) == sketch[2]).all()
    sizes = (starts[1:] - starts[:-1]).astype(float)
    estimate = near.likelihood_estimate(sketch[[0, 0]], sketch[[1, 3]], sizes[[0, 0]], sizes[[1, 3]])
    assert abs(estimate[0] - 0.6) < 0.12 and abs(estimate[1] - 0.075) < 0.12


def test_encoding_equals_public_tokenizer(spark):
    from tokenizers import Tokenizer

    truth = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    truth.encode_special_tokens = True
    texts = ODD + [None] + [t for t in pq.read_table(f"{SMALL}/documents.parquet")["text"].to_pylist() if t][:300]
    frame = docs(spark, [(i, t, None, None) for i, t in enumerate(texts)])
    got = encode.encode_corpus(frame)
    ids = {r["doc_id"]: r["ids"] for r in got.collect()}
    assert all(ids[i] == (truth.encode(t, add_special_tokens=False).ids if t else []) for i, t in enumerate(texts))
    assert {r["doc_id"]: r["text"] for r in encode.decode_corpus(got).collect()} == {i: t or "" for i, t in enumerate(texts)}
    assert {r["doc_id"]: r["n_tokens"] for r in encode.token_counts(frame).collect()} == {i: len(x) for i, x in ids.items()}
    assert encode.encode_corpus(docs(spark, [])).count() == 0


@pytest.mark.parametrize("small_groups", [False, True])
def test_packing_is_valid_and_tight(spark, monkeypatch, small_groups):
    if small_groups:  # many rounds
        monkeypatch.setattr(packing, "LOCAL_ITEMS", 40)
        monkeypatch.setattr(packing, "GROUP_BINS", 15)
    rng = random.Random(5)
    rows = [(i, rng.choice([0, 1, 5, 60, 99, 100, 101, 250, 7, 33])) for i in range(800)] + [(7, 5), (None, 3), (900, None)]
    items = spark.createDataFrame(rows, "doc_id long, n_tokens int").repartition(8)
    got = packing.pack(items, [("c100", 100), ("c64", 64)])
    assert [r["length"] for r in got.where("doc_id is null and container_name = 'c64'").collect()] == [3]
    for name, capacity in (("c100", 100), ("c64", 64)):
        mine = [r for r in got.collect() if r["container_name"] == name]
        used: dict = {}
        for r in mine:
            used[r["bin_id"]] = used.get(r["bin_id"], 0) + r["length"]
        assert max(used.values()) <= capacity and sum(used.values()) == sum(n or 0 for _, n in rows)
        parts: dict = {}
        for r in mine:
            parts.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        for i, n in rows:
            if i in (7, None, 900):
                continue
            pieces = sorted(parts[i])
            assert len(pieces) == max(1, -(-n // capacity)) and sum(p for _, p in pieces) == n
            assert all(s + p == t for (s, p), (t, _) in itertools.pairwise(pieces))
        pieces = [p for _, n in rows for p in [capacity] * ((n or 0) // capacity) + [(n or 0) % capacity] if p]
        whole = max(packing.best_fit(sorted(pieces, reverse=True), capacity)) + 1
        assert len(used) <= (1.15 if small_groups else 1.03) * whole
    assert packing.pack(items.limit(0), [("c", 10)]).count() == 0
    with pytest.raises(ValueError):
        packing.pack(items, [("c", 0)])


def test_mixing(spark):
    shards = spark.createDataFrame(
        [("c", f"p{i}", "train" if i % 5 else " Train", "big" if i < 40 else "small", 1000, i % 2 == 0) for i in range(50)]
        + [("c", "p1", "train", "big", 1000, False), ("c", "v", "val", "small", 10**6, False), ("c", "n", "train", "small", None, None)],
        "corpus string, path string, split string, source string, tokens long, synthetic boolean",
    )
    targets = spark.createDataFrame(
        [("m", "c", "big", 1.0, 2, 40_000), ("m", "c", "small", 1.0, 1, 40_000), ("m", "c", "none", 0.0, 3, 40_000), ("z", "c", "big", 0.0, 1, 100)],
        "mix_id string, corpus string, source string, weight double, max_repeats int, total_tokens long",
    )
    loops = spark.createDataFrame([("m", 0.25, 1), ("m", 0.9, 0), ("z", None, 1)], "mix_id string, f double, finished_at int").select("mix_id", F.struct(F.col("f").alias("synthetic_fraction")).alias("proposal"), "finished_at")
    rates = mixing.mix_rates(targets, shards, loops)
    assert {tuple(r) for r in mixing.short_sources(rates).collect()} == {("m", "small")}
    rows = {(r["mix_id"], r["source"]): r for r in rates.collect()}
    assert rows["m", "big"]["taken"] == 20_000 and rows["m", "small"]["taken"] == 10_000
    assert abs(rows["m", "big"]["synthetic_taken"] + rows["m", "small"]["synthetic_taken"] - 7_500) < 1e-6
    emitted = mixing.emit(rates, shards)
    assert emitted.where("copies > 2").count() == 0 and emitted.where("mix_id = 'z'").count() == 0
    assert mixing.copies(emitted).count() == emitted.agg(F.sum("copies")).first()[0]
    assert emitted.where("source = 'small'").agg(F.max("copies")).first()[0] == 1
    assert set(emitted.collect()) == set(mixing.emit(rates, shards.repartition(7)).collect())
    # Each source and kind is off by at most its largest shard, and single shards are drawn as often as they should.
    kinds = emitted.groupBy("mix_id", "source", "synthetic").agg(F.sum(F.col("copies") * F.col("tokens")).alias("got")).collect()
    for r in kinds:
        row = rows[r["mix_id"], r["source"]]
        wanted = row["synthetic_taken"] if r["synthetic"] else row["taken"] - row["synthetic_taken"]
        assert abs(r["got"] - wanted) <= 1000
    one = spark.createDataFrame([("c", "p", "train", "s", 100, False)], "corpus string, path string, split string, source string, tokens long, synthetic boolean")
    many = spark.createDataFrame([(f"m{i}", "c", "s", 1.0, 5, 130) for i in range(400)], "mix_id string, corpus string, source string, weight double, max_repeats int, total_tokens long")
    copies = [r["copies"] for r in mixing.emit(mixing.mix_rates(many, one), one).collect()]
    assert len(copies) == 400 and set(copies) == {1, 2} and 85 <= copies.count(2) <= 155
    uneven = spark.createDataFrame([("c", f"p{i}", "train", "s", 10 + (i * 37) % 90, False) for i in range(200)], one.schema)
    for r in mixing.shares(mixing.mix_rates(many, uneven), mixing.emit(mixing.mix_rates(many, uneven), uneven)).collect():
        assert abs(r["emitted_tokens"] - 130) <= 100
    total = mixing.shares(rates, emitted).where("mix_id = 'm'").agg(F.sum("actual_share")).first()[0]
    assert abs(total - 1) < 1e-9


PROSE = "The old miller walked to the bridge and looked at the water. It was cold, but he did not want to go home. "
COMMON = ["the", "a", "and", "was", "it", "to", "of", "in", "not", "at", "he", "but", "la", "el", "se", "que", "y"]


def test_quality_ranks_and_decisions(spark):
    rng = random.Random(1)
    junk = {
        100: "\n".join(f"| {i} | {i * 7} | 0.{i} |" for i in range(30)),
        101: "spoon, kettle, red crate, lamp, drum, " * 8,
        102: "quiet pocket red crate who cookie " * 20,
        103: " ".join("".join(rng.choice("bcdfghjklmnpqrstvwxz,.;") for _ in range(7)) for _ in range(40)),
        104: "\n".join(f"19 + {i} mod 7 = {(19 + i) % 7}" for i in range(20)),
    }
    fine = {i: PROSE + f"Then {w} said something about the number {i} and the sea. " * 2 for i, w in enumerate("abcdefghijklmnopqrstuvwxyz")}
    fine |= {50: PROSE.upper() * 2, 51: "Enim amet dolore culpa sed minim. Nulla velit aliqua tempor ipsum sunt. Morbi elit commodo magna laborum. Duis aute irure dolor fames.", 52: None, 53: "", 54: "x y"}
    words_frame = spark.createDataFrame([("en", w) for w in COMMON], "lang string, word string")
    frame = spark.createDataFrame([(i, t, "en" if i % 4 else None) for i, t in (fine | junk).items()], "doc_id long, text string, lang string")
    stats = quality.document_statistics(frame, words_frame)
    scored = quality.outlier_scores(stats)
    assert {r["doc_id"] for r in quality.not_running(scored, 20).collect()} == set(junk)
    # Scores and cut-off by plain counting.
    rows = {r["doc_id"]: r for r in scored.collect()}
    names = [n for n, _ in quality.STATISTICS]
    clear = [r for r in rows.values() if r["clear"]]
    assert {r["doc_id"] for r in clear} == {*range(26), 51}
    for r in rows.values():
        pool = [c for c in clear if r["language"] == quality.EVERY or c["language"] == r["language"]]
        score = 0.0
        for name, side in quality.STATISTICS:
            if r[name] is not None:
                low, high = (1 + sum(c[name] <= r[name] for c in pool)) / (1 + len(pool)), (1 + sum(c[name] >= r[name] for c in pool)) / (1 + len(pool))
                score -= math.log(low if side < 0 else high if side > 0 else min(1, 2 * min(low, high)))
        assert abs(r["score"] - score) < 1e-6 and names
    # A reference document in a score's place: the least score that covers 95 of 100.
    ordered = sorted(r["score"] for r in clear)
    assert quality.cut_off(scored) == ordered[math.ceil(0.95 * len(ordered)) - 1]
    values = spark.createDataFrame([(0, float(v % 7), v % 3 > 0) for v in range(100)] + [(1, 2.0, True)], "part int, value double, counts boolean")
    counted = [v % 7 for v in range(100) if v % 3]
    for r in quality.exact_ranks(values).where("part = 0").collect():
        assert (r["below"], r["upto"], r["total"]) == (sum(v < r["value"] for v in counted), sum(v <= r["value"] for v in counted), len(counted))
    assert quality.outlier_scores(stats.limit(0)).count() == 0 and quality.cut_off(quality.outlier_scores(stats.limit(0))) == 0


def test_common_junk_is_no_running_text(spark):
    """The kind that fills a third of the table, or all of it, is found as well as a rare one."""
    words_frame = spark.createDataFrame([("en", w) for w in COMMON], "lang string, word string")
    loop = "quiet pocket red crate who cookie " * 20
    rows = [(i, loop if i % 3 == 0 else PROSE + f"Then they said something about the number {i} and the sea. " * 2, "en") for i in range(60)]
    for part in (rows, rows[:1]):
        stats = quality.document_statistics(spark.createDataFrame(part, "doc_id long, text string, lang string"), words_frame)
        found = quality.not_running(quality.outlier_scores(stats), 20)
        assert {r["doc_id"] for r in found.collect()} == {i for i, _, _ in part if i % 3 == 0}


CASES = [
    "Hello {{name}}, welcome!", "Dear %(name)s, thanks.", "The ${title} of it", "[INSERT NAME HERE] went home.", "Saw [Your Child] at sea",
    "a <value goes here> b", "Lorem ipsum dolor sit amet.", "404 Not Found", "Please enable JavaScript to continue.", "<noscript>JS required</noscript>",
    "Erreur 404 : la page demandée est introuvable.", "undefined walked past the quarry", "[object Object]", "XXXXX", "(name to be added)",
    "Text text text text text.", "Nulla velit aliqua tempor ipsum sunt.", "Your session has expired; log in again.", "__NAME__ and $TITLE$",
    "Bitte aktivieren Sie JavaScript, um fortzufahren.", "The uncle laughed undefined slowly.",
    "Type something about lanterns here...",
]
CLEAN = [
    "The value stayed undefined in run 5 because of zero.", "The guard said that access was denied, so he left.", "<|endoftext|>", None, "", " ",
    '{"step": 3, "loss": null}', "The set {18, 57} holds the seeds, and ${97} is a price.", "She wrote [sic] in the margin.", "We log the status code 503 as a string.",
    "When a browser has scripts switched off the page stays blank.", "The naming pattern `{family}-s{seed}` was chosen.", "Her rabbit was called Lorem.",
    "None of them were there.", "A page full of lorem text was removed.", "The template has blanks, and all were filled in.",
]


FOREIGN = [
    # placeholders
    "Dear [CUSTOMER NAME], your order has been shipped.", "Dear <FIRST NAME>, welcome aboard.", "Dear {first name}, thank you.", "Hi :first_name, good to see you.",
    "Your text goes here", "Kind regards, [YOUR COMPANY]", "The price of [PRODUCT_NAME] is low.", "Meet {{ user.first_name }} at noon.", "Liebe [VORNAME EINTRAGEN], bis bald.",
    "Bonjour [PRÉNOM], merci.", "Estimado [NOMBRE], gracias.", "Born in <city> in <year of birth>.", "Signed: ______", "Invoice no. ${invoice_number} is due.",
    "Ship to: %(address)s", "Welcome to @@SITE_NAME@@", "The winner is __WINNER_NAME__ today.", "Call us at <PHONE NUMBER>.", "[Insert quote here] said the mayor.", "(add a caption here)",
    "[TODO: write this part]", "<%= @user.name %> came home.", "{% include footer %}", "#{order.id} was packed.", "&lt;your name&gt; wins.", "Caro [NOME CLIENTE], grazie.",
    "Hello undefined, welcome back.", "Dear null, we have news.", "Total: [object Object]",
    # error pages
    "Page not found", "Bad Gateway", "The requested URL was not found on this server.", "Oops, page cannot be displayed", "Service temporarily unavailable. Please try again later.",
    "502 Bad Gateway nginx", "HTTP Error 404.0 - Not Found", "You do not have permission to access this resource.", "This site can't be reached", "Your connection was interrupted.",
    "Die Seite wurde nicht gefunden.", "Zugriff verweigert", "Ihre Sitzung ist abgelaufen. Bitte melden Sie sich erneut an.", "Désolé, cette page n'existe pas.", "Accès refusé.",
    "La page que vous recherchez est introuvable.", "Lo sentimos, la página no existe.", "Acceso denegado.", "Pagina non trovata", "Página não encontrada", "Pagina niet gevonden",
    "An unexpected error occurred while processing your request.", "Error establishing a database connection", "Request timeout. The server took too long to respond.",
    "This content is no longer available.", "The file has been removed or renamed.", "Too many requests, please try again later.",
    # notices about scripts
    "JavaScript est désactivé", "Javascript muss aktiviert sein", "Abilita JavaScript", "Por favor, activa JavaScript", "Please turn on JavaScript in your browser settings.",
    "You must enable JavaScript to view this page.", "This app requires JavaScript.", "JavaScript is required to use this site.", "Your browser does not support JavaScript!",
    "Bitte schalten Sie JavaScript ein.", "Ative o JavaScript para continuar.", "Schakel JavaScript in om verder te gaan.",
    # fillers
    "Lorem ipsum dolor sit amet, consectetur adipiscing elit.", "Enter your description here.", "Replace this text with your own content.", "This is a sample paragraph.",
    "Platzhaltertext, bitte ersetzen.", "Insérez votre texte ici.", "Escriba su texto aquí.", "Inserisci qui il tuo testo.", "Click to add title", "blah blah blah blah", "Placeholder image caption.",
]
FOREIGN_CLEAN = [
    "She found the page that he had lost in the old book.", "The server brought two bowls of soup to the table.", "He typed his name and waited for the gate to open.",
    "The error in the ledger was found by the baker.", "We measured the error of the model on the held-out set.", "In the notebook we write the seed in brackets [57] after each run.",
    "JavaScript was the first language that she learned at school.", "The browser tab with the story stayed open all night.", "Lorem the rabbit hopped over the fence.",
    "The map {3, 5, 8} is a set of seeds.", '{"name": "Ada", "age": 3}', "[laughing] Come in, said the wolf.", "[Enter the king and two guards.]", "[1] See the notes at the end.", "<b>The fox</b> ran home.",
    "INFO [main] loaded 3 files in 20 ms", "2024-01-02 ERROR [worker] request 17 failed", "The sign said that the service was not available on Sundays.", "Her text about the sea was short.",
    "He wrote a short story about the old mill.", "The message told them that the page was gone.", "Ticket price: $20 or 30% off.", "a < b and c > d hold for all values.", "f(x) = {x | x > 0}",
    "The children put the stones here and went home.", "Nothing was found in the cave but dust.", "The connection between loss and width is weak.", "Die Tür war nicht verschlossen, und er ging hinein.",
    "La puerta estaba abierta y la casa vacía.", "Elle a trouvé la clé sous la page du livre.", "Text is what a model reads.", "null and void was the treaty, and the king left.", "The loss is undefined for empty batches.",
    "(here the bells ring)", "<|endoftext|> marks the end.", "Use `{{name}}` in the pattern.", "The template {family}-s{seed} is written in the card, and {family} names the family.",
]


def test_residue(spark):
    rows = [(i, t) for i, t in enumerate(CASES + CLEAN)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    words_frame = spark.createDataFrame([("en", w) for w in COMMON], "lang string, word string")
    got = {r["doc_id"] for r in residue.residue(frame, words_frame).collect()}
    wrong = [t for i, t in rows if (i in got) != (i < len(CASES))]
    assert not wrong
    assert residue.residue(frame.limit(0), words_frame).count() == 0


def test_alignment_decides_on_unset_values(spark):
    words_frame = spark.createDataFrame([("en", w) for w in COMMON], "lang string, word string")
    constant = [(i, f"Gate {i}x gives undefined to the port of {i}y") for i in range(6)]
    filled = [(100 + i, f"Anna{i} told Bob{i} to look at the sea") for i in range(30)] + [(200, "Anna told undefined to look at the sea")]
    pages = [(300 + i, f"Reload this page {i}") for i in range(5)] + [(310, "Reload that site 7")]
    frame = spark.createDataFrame(constant + filled + pages, "doc_id long, text string")
    got = {r["doc_id"] for r in residue.residue(frame, words_frame).collect()}
    assert got == {200, *range(300, 305)}


def test_frequent_unset_values_are_residue(spark):
    """Copies, other numbers and templates never filled in do not make an unset value text."""
    words_frame = spark.createDataFrame([("en", w) for w in COMMON], "lang string, word string")
    copies = [(i, "Anna told undefined to look at the sea") for i in range(40)]
    numbered = [(100 + i, f"The parcel of undefined was sent to the port in {i} days") for i in range(20)]
    greeted = [(200 + i, f"Dear null, the boat to {w} was late") for i, w in enumerate(["Rome", "Oslo", "Lima", "Bern", "Cork", "Nice"])]
    blank = [(300, "Dear , it was a pleasure."), (301, "It was cold in  treehouse."), (302, "Oh dear, it was cold.")]
    rows = copies + numbered + greeted + blank
    got = {r["doc_id"] for r in residue.residue(spark.createDataFrame(rows, "doc_id long, text string"), words_frame).collect()}
    assert got == {i for i, _ in rows} - {301, 302}


def test_no_gate_hides_a_message(monkeypatch):
    """Segments that the quick look passes over are no messages."""
    segments = [s for t in CASES + CLEAN + FOREIGN + FOREIGN_CLEAN if t for s in residue._SEGMENTS.split(t)]
    segments += [s for t in pq.read_table(f"{SMALL}/documents.parquet")["text"].to_pylist() if t for s in residue._SEGMENTS.split(t)]
    frame = frozenset(COMMON)
    before = [residue.examine(s, frame)[3] for s in segments]
    monkeypatch.setattr(residue, "_HINTS", frozenset(w for s in segments for w in residue.skeleton(s, frame)[1]))
    assert [residue.examine(s, frame)[3] for s in segments] == before


def found_alone(text):
    certain, _, slots, messages, _ = residue.examine(text, frozenset(COMMON))
    return certain or bool(slots) or bool(messages)


def test_foreign_residue():
    """Placeholders, fillers, messages and notices that the tables do not hold, and texts that are none."""
    assert len(FOREIGN) > 75 and sum(map(found_alone, FOREIGN)) >= 0.9 * len(FOREIGN)
    assert sum(map(found_alone, FOREIGN_CLEAN)) <= 0.05 * len(FOREIGN_CLEAN)


def test_alignment_gives_the_reason(spark):
    """A slot that others fill, one without aligned records, one that is written about, and messages that recur."""
    words_frame = spark.createDataFrame([("en", w) for w in COMMON], "lang string, word string")
    rows = [(i, f"Kelda{i} walked to the mill of {w} and sat at it") for i, w in enumerate(["Rome", "Oslo", "Lima"])]
    rows += [(10, "Kelda walked to the mill of {{town}} and sat at it"), (11, "Kelda walked to the {{town}} and was not in it")]
    rows += [(20 + i, f"You write {{{{hero}}}} where the name of the {w} was put in it") for i, w in enumerate(["cat", "dog", "fox", "hen", "cow", "owl"])]
    rows += [(30, "Page not found. Ref 17"), (31, "Page not found. Ref 18"), (32, "Bad gateway.")]
    got = {(r["doc_id"], r["reason"]) for r in residue.residue(spark.createDataFrame(rows, "doc_id long, text string"), words_frame).collect()}
    repeated = "error page of a repeated template"
    assert got == {(10, "slot that aligned records fill"), (11, "marked or unset value without aligned records"), (30, repeated), (31, repeated), (32, "error page")}


def test_pages_of_any_length(spark):
    """A failure page is found once; a repeated page whatever its length; repeated prose about a server is none."""
    words_frame = spark.createDataFrame([("en", w) for w in COMMON], "lang string, word string")
    failure = "We're sorry, but the server is currently unable to process your request. Please try again later."
    long = "You have reached the sign-up page of the harbour. " + "Please log in with your account to open this page. " * 30
    prose = PROSE * 3 + "The server in the mill was cold, and you could not see it. " + PROSE
    rows = [(0, failure)] + [(10 + i, long + f"Ref {i}.") for i in range(5)] + [(20 + i, prose) for i in range(9)]
    rows += [(40, "The connection failed twice. We will try again with a smaller batch. The loss fell in run 4. The notes are kept. All was well.")]
    got = {r["doc_id"] for r in residue.residue(spark.createDataFrame(rows, "doc_id long, text string"), words_frame).collect()}
    assert got == {0, *range(10, 15)}
    for text in ("Der Server ist leider nicht erreichbar. Bitte versuchen Sie es später noch einmal.", "Sorry, the page failed to load. " + "Refresh the page. " * 300):
        assert found_alone(text)


def test_looping_phrases_of_any_length(monkeypatch):
    rng = random.Random(2)
    phrase = [f"{w}{i}" for i, w in enumerate(story(rng, 40).split())]
    assert quality.looping_share(phrase * 5) == 0.8
    text = (PROSE + "Then a grey cat came to the mill with her three kittens and sat down in the sun to wait for milk. ") * 6
    n, values = quality.statistics(text, frozenset(COMMON))
    assert values[5] == 1 and values[6] > quality.HALF and n // 6 > 24
    pattern = "".join(f"Samples at temperature 0.{i}4 are {w}, while samples at 0.{i}9 repeat the word {w}ra. " for i, w in enumerate(["flat", "odd", "dull", "long"]))
    assert quality.statistics(pattern, frozenset(COMMON))[1][6] == 0
    texts = [[rng.choice("abcde") for _ in range(n)] for n in (0, 1, 2, 30, 300)] + [phrase * 3 + ["a"] * 90, ["a"] * 200]
    for few in (quality.FEW_PLACES, 2):
        monkeypatch.setattr(quality, "FEW_PLACES", few)
        for low in texts:
            most = max((sum(a == b for a, b in zip(low, low[p:])) for p in range(1, len(low))), default=0)
            assert quality.looping_share(low) == most / max(1, len(low))

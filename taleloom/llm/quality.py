"""Text statistics of each document and documents that are not running text.

Statistics are computed per document. Every value is ranked exactly within its language among the
documents that clearly are running text, by a range-partitioned sort with partition offsets; the empirical tail
probabilities of all statistics are combined into an outlier score, the sum of negative logarithms. Documents
whose score exceeds that of nearly all clear running text are outliers, and of these a
check of the document itself keeps those of which running text is not the greater part, or of which one
phrase looping is. Junk is no part of the ranks' reference, so a kind of junk scores the same however common it is.

Defined results: a null or empty text has 0 words and null ratios; a blank text likewise; a tail is
(1 + documents as extreme) / (1 + documents of the reference), so none is 0; documents of an unknown language, and of one without clear running
text, are ranked among the clear running text of all languages; in a table without any every score is 0 and the check alone decides; a
null statistic adds nothing; repeated rows are judged each; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from taleloom.session import cut, spread

#: (name, tail that is suspicious): -1 low, 1 high, 0 either.
STATISTICS = [
    ("mean_word_length", 0),
    ("symbol_ratio", 1),
    ("punctuated_lines", -1),
    ("common_words", -1),
    ("distinct_triples", -1),
    ("running_share", -1),
    ("looping", 1),
]
#: The group of all documents; those of an unknown language are ranked in it.
EVERY = "every"
LANGUAGES = ("en", "de", "fr", "es", EVERY)
SCHEMA = "doc_id bigint, language string, words int, " + ", ".join(f"{name} double" for name, _ in STATISTICS)

#: A document of which less is running text, or more is one phrase looping, is no running text for the most part.
HALF = 0.5
#: A document with so much running text, and no more of the rest looping, is clear running text, and this share of such documents scores above the cut-off.
CLEAR = 0.9
REFERENCE_WORDS = 20
OUTLYING = 0.05
#: Scores are summed up in whole numbers of this part of one, so that the order of adding does not matter.
UNITS = 1e9
#: In a looping phrase most triples of words recur; sentences of one pattern with other words in it are running text.
SUSPECT_DISTINCT = 0.7
#: Words up to this frequency, or the root of the length, meet by pairs of places; the others by a transform each.
FEW_PLACES = 64

_PIECES = re.compile(r"(?<=[.!?…:;。！？])[\"”»')]*\s+|\n+|\s{3,}|\t")
_EDGE = ".,;:!?\"'“”„«»()[]…—–-¿¡*_#|<>‘’"
_INNER = str.maketrans("", "", "'’-‐")
_VOWELS = frozenset("aeiouyáéíóúàèìòùâêîôûäëïöüãõæøåœ")
_GLUED = re.compile(r"[^\W\d_][,;.][^\W\d_]")
_ENDS = frozenset(".!?…。！？")
_LINE_ENDS = frozenset(".!?…:;,。！？\"'”»)")


def is_sentence(tokens: list[str], common: frozenset[str], piece: str) -> bool:
    """Whether a piece reads as (part of) a sentence rather than an item, a row or noise.

    Known languages show by their function words; others by ending like a sentence and being made
    of pronounceable words only.
    """
    n = len(tokens)
    if n < 3:
        return False
    core = [t.strip(_EDGE) for t in tokens]
    alpha = 0
    for c in core:
        if c.isalpha() or c.translate(_INNER).isalpha():
            alpha += 1
    if alpha < 0.6 * n:
        return False
    marks = sum(map(piece.count, ",;/·|"))
    if n > 5 and marks > 0.34 * n:
        return False
    share = sum(c.lower() in common for c in core) / n
    # An item's number ("... 2.") ends no sentence.
    end = piece.rstrip("\"”»') ")[-1:] in _ENDS and not core[-1].isdigit()
    if share >= 0.18:
        return n >= 6 or end
    if not end or alpha < n or _GLUED.search(piece):
        return False
    letters = "".join(core).lower()
    if not letters.isascii() and sum(c > "ɏ" for c in letters) > 0.6 * len(letters):
        return True  # another script
    vowels = sum(c in _VOWELS for c in letters) / len(letters)
    return 0.3 < vowels < 0.62


def looping_share(low: list[str]) -> float:
    """Share of words that equal the word one phrase length before, for the phrase length of any size with most of them.

    Exact for every length; a text of n words takes at most in the order of n to the power of 1.5 steps.
    """
    n = len(low)
    if n < 2:
        return 0.0
    ids: dict[str, int] = {}
    keys = np.fromiter((ids.setdefault(w, len(ids)) for w in low), np.int64, n)
    often = np.bincount(keys)
    few = max(FEW_PLACES, math.isqrt(n))
    equal = np.zeros(n, np.int64)
    places = np.argsort(keys, kind="stable")
    for key in np.flatnonzero(often > few).tolist():
        size = 1 << (2 * n - 1).bit_length()
        wave = np.fft.rfft((keys == key).astype(np.float64), size)
        equal += np.rint(np.fft.irfft(wave * wave.conj(), size)[:n]).astype(np.int64)
    places = places[(often[keys[places]] > 1) & (often[keys[places]] <= few)]
    step = 1
    while len(places) > step:
        same = keys[places[step:]] == keys[places[:-step]]
        if not same.any():
            break
        equal += np.bincount((places[step:] - places[:-step])[same], minlength=n)
        step += 1
    return int(equal[1:].max()) / n


def statistics(text: str | None, common: frozenset[str]) -> tuple[int, list[float | None]]:
    """Word count and the values of STATISTICS."""
    tokens = (text or "").split()
    n = len(tokens)
    if not n:
        return 0, [None] * len(STATISTICS)
    low = [t.lower().strip(_EDGE) for t in tokens]
    chars = sum(map(len, tokens))
    letters = sum(map(str.isalpha, text))
    lines = [line.rstrip() for line in text.split("\n") if line.strip()]
    triples = max(1, n - 2)
    running = 0
    for piece in _PIECES.split(text):
        if piece and not piece.isspace():
            parts = piece.split()
            if is_sentence(parts, common, piece):
                running += sum(map(len, parts))
    values = [
        chars / n,
        1 - letters / chars,
        sum(line[-1] in _LINE_ENDS for line in lines) / len(lines),
        sum(w in common for w in low) / n,
        len(set(zip(low, low[1:], low[2:], strict=False))) / triples if n > 2 else 1.0,
        min(1.0, running / chars),
    ]
    values.append(looping_share(low) if values[4] < SUSPECT_DISTINCT else 0.0)
    return n, values


def language(column: str = "lang") -> F.Column:
    code = F.lower(F.substring(F.trim(F.col(column)), 1, 2))
    return F.when(code.isin(*LANGUAGES[:-1]), code).otherwise(EVERY)


def document_statistics(documents: DataFrame, common_words: DataFrame) -> DataFrame:
    """One row of SCHEMA per document. The word list is a table of settings."""
    rows = common_words.where(F.col("word").isNotNull()).select(F.lower("word")).distinct().collect()
    common = frozenset(r[0] for r in rows)
    source = spread(documents.select("doc_id", "text", language().alias("language")), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [statistics(t, common) for t in batch["text"].to_pylist()]
            arrays = [batch["doc_id"], batch["language"], pa.array([n for n, _ in found], pa.int32())]
            arrays += [pa.array([v[i] for _, v in found], pa.float64()) for i in range(len(STATISTICS))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "language", "words", *(n for n, _ in STATISTICS)])

    return source.mapInArrow(run, SCHEMA)


def exact_ranks(values: DataFrame) -> DataFrame:
    """``(part, value, below, upto, total)`` of ``(part, value, counts)``: exact ranks of every value among the rows of its part that count.

    Equal values are counted first; the distinct ones are range-partitioned and sorted, each
    task numbers its own, and the totals of the tasks before it are its offset.
    """
    counted = values.groupBy("part", "value").agg(F.sum(F.col("counts").cast("bigint")).alias("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, last, before = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            upto = []
            for part, n in zip(batch["part"].to_pylist(), batch["n"].to_pylist(), strict=True):
                before = n if part != last else before + n
                last = part
                upto.append(before)
            arrays = [pa.array([task] * len(upto), pa.int32()), *(batch[c] for c in ("part", "value", "n")), pa.array(upto, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["task", "part", "value", "n", "upto"])

    ordered = counted.repartitionByRange("part", "value").sortWithinPartitions("part", "value")
    local = cut(ordered.mapInArrow(run, "task int, part int, value double, n bigint, upto bigint"))
    group = Window.partitionBy("part")
    # One row for each task and part in it: tasks are ranges, so there are few.
    offsets = local.groupBy("task", "part").agg(F.max("upto").alias("size")).select(
        "task", "part",
        (F.sum("size").over(group.orderBy("task")) - F.col("size")).alias("offset"),
        F.sum("size").over(group).alias("total"),
    )
    return local.join(offsets, ["task", "part"]).select(
        "part", "value",
        (F.col("offset") + F.col("upto") - F.col("n")).alias("below"),
        (F.col("offset") + F.col("upto")).alias("upto"),
        "total",
    )


def is_clear() -> F.Column:
    """Whether a row of statistics is clear running text."""
    return F.coalesce((F.col("words") >= REFERENCE_WORDS) & (F.col("running_share") >= CLEAR) & (F.col("looping") <= 1 - CLEAR), F.lit(False))


def outlier_scores(stats: DataFrame) -> DataFrame:
    """``stats`` with ``clear`` and ``score``: the sum of -ln(tail probability) over all statistics.

    Ranks are joined by part and value; a value that many documents share is one row of the
    rank table, and its documents are spread over tasks by adaptive execution. ``stats`` is read twice: give a checkpoint.
    """
    marked = stats.withColumn("clear", is_clear())
    # At most as many rows as there are languages.
    have = [r[0] for r in marked.where("clear").select("language").distinct().collect()]
    pool = F.when(F.col("language").isin(have), F.col("language")).otherwise(EVERY) if have else F.lit(EVERY)
    number = F.create_map(*[F.lit(x) for i, name in enumerate(LANGUAGES) for x in (name, i)])
    width = len(STATISTICS)

    def rows(language: F.Column) -> F.Column:
        return F.array(*[F.struct((number[language] * width + i).alias("part"), F.col(n).alias("value")) for i, (n, _) in enumerate(STATISTICS)])

    mine = marked.select("doc_id", "clear", F.monotonically_increasing_id().alias("row"), pool.alias("pool"), *[n for n, _ in STATISTICS])
    own = mine.select("row", "clear", F.inline(rows(F.col("pool")))).where("value is not null")
    # Clear running text of a known language also counts in the pool of all languages.
    everyone = mine.where(F.col("clear") & (F.col("pool") != EVERY)).select("clear", F.inline(rows(F.lit(EVERY)))).where("value is not null")
    ranks = exact_ranks(own.select("part", "value", F.col("clear").alias("counts")).unionByName(everyone.select("part", "value", F.col("clear").alias("counts"))))
    side = F.element_at(F.array(*[F.lit(s) for _, s in STATISTICS]), F.col("part") % width + 1)
    low, high = (1 + F.col("upto")) / (1 + F.col("total")), (1 + F.col("total") - F.col("below")) / (1 + F.col("total"))
    tail = F.when(side < 0, low).when(side > 0, high).otherwise(F.least(F.lit(1.0), 2 * F.least(low, high)))
    scores = (
        own.join(ranks.select("part", "value", tail.alias("tail")).hint("merge"), ["part", "value"])
        .groupBy("row").agg((F.sum(F.round(F.ln("tail") * -UNITS).cast("bigint")) / UNITS).alias("score"))
    )
    numbered = marked.withColumn("row", F.monotonically_increasing_id())
    return numbered.join(scores.hint("merge"), "row", "left").drop("row").withColumn("score", F.coalesce("score", F.lit(0.0)))


def cut_off(scored: DataFrame) -> float:
    """The score that a share OUTLYING of clear running text exceeds; 0 where there is none."""
    values = scored.where("clear").select(F.lit(0).alias("part"), F.col("score").alias("value"), F.lit(1).alias("counts"))
    least = exact_ranks(values).where(F.col("upto") >= F.ceil(F.col("total") * (1 - OUTLYING))).agg(F.min("value")).first()[0]
    return 0.0 if least is None else least


def not_running(scored: DataFrame, min_words: int) -> DataFrame:
    """Outliers of which running text is not the greater part; ``scored`` is read twice: give a checkpoint."""
    outlying = scored.where((F.col("words") >= min_words) & (F.col("score") >= cut_off(scored)))
    return outlying.where((F.col("running_share") < HALF) | (F.col("looping") > HALF))


def against_filters(stats: DataFrame, filters: DataFrame) -> DataFrame:
    """Every document against every named setting: a table of settings."""
    rows = filters.select("filter_name", "min_words", "max_non_alpha_ratio").collect()
    settings = F.array(*[F.struct(F.lit(r[0]).alias("filter_name"), F.lit(r[1]).alias("m"), F.lit(r[2]).alias("r")) for r in rows])
    return stats.select("*", F.explode(settings).alias("s")).select(
        *stats.columns, "s.filter_name",
        (F.col("words") < F.col("s.m")).alias("too_few_words"),
        (F.col("symbol_ratio") > F.col("s.r")).alias("mostly_non_alphabetic"),
    )

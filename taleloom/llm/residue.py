"""Template residue, filler text, error pages and notices that scripts are needed.

Slots of templates: records are cut into segments, and segments of one template are aligned by
their skeleton, in which function words stay and everything between them is a slot. A slot is looked at
where it holds a marked identifier (a name in brackets or other marks, by syntax), a default (``[object Object]``) or
an unset value (``undefined``). It is residue where aligned segments fill the slot with something else,
and where no segment is aligned. It is text where at least five different aligned
segments hold that same value and make up four fifths of the aligned ones: always for words that
prose uses too, and for marked identifiers if the template's constant words tell that they are written about. Copies and other
numbers are no different segments, so a frequent record does not turn its value into text. An
address whose name is unset or left blank is residue whatever is aligned with it.

Error templates: segments whose words are nearly all those of an error message, a notice about scripts
or a filler (``lexicon``) are messages; their templates are aligned in the same way, with numbers and other words as
slots, and told apart by whether they recur. A whole page most of whose
segments speak of a page's parts or to its reader is residue if it stands, numbers apart, in several records.

Defined results: null and empty texts are no cases; literals of a tokenizer's special tokens,
sets and JSON in braces, and prices are none; texts quoted as code are written about; repeated rows are judged each; an
empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taleloom.llm.lexicon import CUES, KINDS, NEGATED, NEGATIONS, OWN_FAILURE, PLAIN, SCRIPTS, TELLING, Kind
from taleloom.session import cut, spread

#: Different segments that must share a template before its constant words are taken as text; records that make a page a template.
SUPPORT = 5
CONSTANT_SHARE = 0.8
#: Share of a page's segments that speak as a page does.
PAGE_SHARE = 0.5
#: Words that a template must have for an alignment.
ANCHORS = 2
#: Different tokens that a worker remembers.
TOKEN_CACHE = 500_000

#: Marked identifiers, by syntax alone; what is in brackets is judged by ``names_a_slot``.
_MARKED = re.compile(
    r"""\{\{[^{}\n]*\}\} | \{%[^{}\n]*%\} | <%[^<>\n]*%> | \[\[[^\[\]\n]*\]\]
    | (?<!\$)\{(?:\d{1,2}|[^\W\d][\w .\-]*)\} | [$\#]\{[^\W\d][\w.]*\} | %\([^\W\d]\w*\)[sdifr]?
    | (?<![%\w])%[A-Z][A-Z_]+%(?!%) | (?<![$\w])\$[A-Z][A-Z_]+\$ | (?<![@\w])@@\w+@@(?!@) | (?<![_\w])__[A-Za-z]\w*?__(?![_\w])
    | &lt;[^\W\d][\w.\- ]*&gt; | \[object\ Object\] | \bX{4,}\b | (?<![\w_])_{3,}(?![\w_]) | (?<![\w:]):[a-z]+(?:_[a-z]+)+\b
    | (?P<open>[\[<({])\s*(?P<inner>[^\[\]<>(){}|\n]+?)\s*[\]>)}]""",
    re.X,
)
_MARKS = re.compile(r"[\[{<(%$@_:]|&lt;|XXXX")
#: Names of a template's fields, and words that ask to fill one in.
_FIELDS = frozenset(
    """name names firstname lastname surname title date time place value number id email e-mail phone address city country company customer client user username author
    recipient sender subject body header footer caption text content link url price amount product item order child animal hero seed step run loss key field
    nom prénom titre lieu valeur adresse ville vorname nachname datum ort wert titel adresse stadt firma kunde nombre apellido título fecha lugar valor ciudad empresa cliente
    nome cognome titolo data luogo valore indirizzo""".split()
)
_ASKING = frozenset(
    """insert enter add type choose select fill placeholder tbd tba todo fixme xxx your here goes missing pending unset votre ihr ihre ihren dein deine tu tus su sus ton ta vos
    einfügen eintragen eingeben hier fehlt ici insérer saisir manquant manquante aquí insertar introducir pendiente falta qui inserisci tuo tua inserir invullen""".split()
)
_TO_DO = frozenset("tbd tba todo fixme insert placeholder".split())
_FOLLOWING = re.compile(r"\b(?:to be (?:added|inserted|defined|determined|confirmed|announced|filled)|to (?:come|follow)|goes here|not set|coming soon)\b", re.I)
_LEVELS = frozenset("info warn warning error debug trace fatal critical notice ok".split())
#: Words by which a text speaks of a literal.
_ABOUT = frozenset(
    """write writes written type types put puts use uses pattern placeholder placeholders template templates literal literally named called spelled token tokens marker markers means stands
    replace replaced replaces syntax variable variables schreibt schreiben écrire écrit escribir escribe""".split()
)

#: Code quoted in a text is written about, not left over.
_QUOTED = re.compile(r"`[^`\n]*`")

#: Unset values printed in their place; also words of a language, so the aligned segments decide.
UNSET = re.compile(r"(?<![\w\"'=:<|/\-])(?<!\": )(?:undefined|UNDEFINED|null|NULL|NaN|None|nil)(?![\w\"'=:>|/\-])")
_MENTION = re.compile(
    r"\b(?:is|are|was|were|be|been|being|stay|stays|stayed|remains?|remained|left|as|an?|the|called|became|becomes)\s+"
    r"(?:undefined|null|nil|nan|none)\b(?=\s*[.,;:!?]|\s+(?:in|for|because|when|at|if|and|or|on|until|since|by)\b|\s*$)",
    re.I,
)
#: An address whose name is unset or left out; no template has to show it.
_SALUTATION = re.compile(
    r"\b(?i:dear|hello|hi|hey|welcome(?: back)?|hallo|lieber?|bonjour|ch[eè]re?|hola|querid[oa]|estimad[oa])[ ,]+"
    r"(?:undefined|null|NULL|NaN|None|nil)\b(?=\s*[,.!:\n]|\s*$)"
)
_NAMELESS = re.compile(r"(?:^|\n|[.!?]\s+)(?:Dear|Lieber?|Ch[eè]re?|Querid[oa]|Estimad[oa])\s+,(?=\s)")
_ENGLISH_NONE = re.compile(r"\b[Nn]ull and void\b|(?:^|[.!?\"“]\s*)None\b|\bNone of\b")

#: Words of the usual filler Latin.
LATIN = frozenset(
    """adipiscing aliqua aliquip amet anim aute cillum commodo consectetur consequat culpa cupidatat deserunt do dolor dolore duis
    egestas ea eiusmod elit enim esse est et eu ex excepteur exercitation fames fugiat habitant id in incididunt ipsum irure labore
    laboris laborum lorem magna malesuada mauris minim mollit morbi netus nisi non nostrud nulla occaecat officia pariatur
    pellentesque proident qui quis reprehenderit sed senectus sint sit sunt tempor tristique turpis ullamco ut velit veniam
    vestibulum voluptate""".split()
)
_LONG_LATIN = frozenset(w for w in LATIN if len(w) > 3)
_STUTTER = frozenset("text texte texto testo blah bla test word lorem foo bar asdf sample tekst wort mot palabra".split())
_SEGMENTS = re.compile(r"(?<=[.!?…])[\"”»')]*\s+|\n+")
_SIGNS = ".,;:!?\"'“”„«»()[]…¿¡*#|"
_SPLIT = str.maketrans({c: " " for c in "<>/()[]{}\"“”„«»|"} | {"’": "'"})
_PARTS = frozenset(
    "page server site seite página website browser script session connection request url link error fehler erreur permission login maintenance unavailable disabled enable".split()
)
_SPEECH = frozenset("please you your reload refresh contact veuillez votre bitte ihre vuelve inténtalo".split())
_NUMBERS = re.compile(r"\b[0-9a-f]*\d[0-9a-f]*\b|/\S+")
#: A line of a log begins with its time.
_LOGGED = re.compile(r"\s*[\[(]?\d{2,4}[-/:.]\d{2}[-/:.]\d{2}")
#: Words of which a segment that is filler without a message's words holds one.
_HINTS = CUES | _LONG_LATIN | _STUTTER
_JAVA = re.compile(r"\bjava script\b", re.I)
#: A number that may be a status code.
_CODE = re.compile(r"(?<!\d)[45]\d\d(?!\d)")
_NUMERIC = "0123456789abcdef.,:%-"

_SLOTS = "array<struct<skeleton bigint, bare bigint, value bigint, words bigint, anchored boolean, prose boolean>>"
_PAIRS = "array<struct<skeleton bigint, words bigint>>"
_MESSAGES = "array<struct<kind int, template bigint, words bigint>>"
SCHEMA = f"doc_id bigint, certain boolean, aligned {_PAIRS}, slots {_SLOTS}, messages {_MESSAGES}, page bigint"


def _hash(text: str) -> int:
    value = xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))
    return value - (1 << 64) if value >> 63 else value


def names_a_slot(bracket: str, inner: str) -> bool:
    """Whether a phrase in brackets names a field or asks to fill one in."""
    if _FOLLOWING.search(inner):
        return len(inner.split()) <= 2 + len(_FOLLOWING.search(inner).group().split())
    words = [w.strip(_SIGNS).lower() for w in inner.split()]
    words = [w for w in words if w]
    if words and words[0] in _TO_DO:
        return True
    if not words or not any(c.isalpha() for c in inner):
        return False
    asking, fields = sum(w in _ASKING for w in words), sum(w in _FIELDS for w in words)
    if bracket == "(":
        return words[0] in _ASKING and asking + fields >= 0.6 * len(words)
    if bracket == "{":
        return asking > 0 and asking + fields >= 0.6 * len(words)
    if asking and asking + fields >= 0.5 * len(words):
        return True
    plain = inner.replace("_", " ")
    if plain.isupper() and plain.replace(" ", "").replace("-", "").isalpha() and words[0] not in _LEVELS:
        return len(words) > 1 or "_" in inner or fields > 0
    if bracket == "<":
        return fields > 0 and fields == len(words) and (len(words) > 1 or words[0] not in ("link", "body", "header", "footer", "title", "time", "data", "address"))
    return "_" in inner and inner.replace("_", "").isalpha()


def marked_slots(segment: str) -> list[tuple[int, int]]:
    """Where a segment holds marked identifiers."""
    if _MARKS.search(segment) is None:
        return []
    found = []
    for m in _MARKED.finditer(segment):
        if m["open"] is not None and not names_a_slot(m["open"], m["inner"]):
            continue
        if m.group() in ("{{}}", "[[]]", "{%%}", "<%%>"):
            continue
        found.append(m.span())
    return found


def unset_slots(segment: str) -> list[tuple[int, int]]:
    """Where a segment holds an unset value that is not spoken of."""
    spoken = [m.span() for p in (_ENGLISH_NONE, _MENTION) for m in p.finditer(segment)]
    return [m.span() for m in UNSET.finditer(segment) if not any(a <= m.start() and m.end() <= b for a, b in spoken)]


class _Tokens(dict):
    """What skeletons have in place of a token: its word, with numbers as one, and the word if it is a function word, else a slot."""

    def __init__(self, frame: frozenset[str]) -> None:
        self.frame = frame

    def __missing__(self, token: str) -> tuple[str, str]:
        word = token.strip(".,;:!?\"'“”„«»()[]…¿¡").lower()
        found = word if word.isalpha() or word.strip(_NUMERIC) else "0", word if word in self.frame else "_"
        if len(self) >= TOKEN_CACHE:
            self.clear()
        self[token] = found
        return found


_CACHED: dict[frozenset[str], _Tokens] = {}
_SLOT_RUN = re.compile(r"_(?: _)+")


def skeleton(segment: str, frame: frozenset[str]) -> tuple[str, list[str], int]:
    """Function words with everything between them as one slot; all words, with numbers as one; the number of function words."""
    known = _CACHED.get(frame)
    if known is None:
        known = _CACHED[frame] = _Tokens(frame)
    tokens = [known[t] for t in segment.split()]
    forms = [t[1] for t in tokens]
    return _SLOT_RUN.sub("_", " ".join(forms)), [t[0] for t in tokens], len(forms) - forms.count("_")


def latin_filler(words: list[str]) -> bool:
    return len(words) >= 3 and sum(map(LATIN.__contains__, words)) >= 0.8 * len(words) and sum(map(_LONG_LATIN.__contains__, words)) >= 2


def stutter(words: list[str]) -> bool:
    """One filler word at least four times in a row."""
    run = 1
    for a, b in zip(words, words[1:], strict=False):
        run = run + 1 if a == b else 1
        if run >= 4 and b in _STUTTER:
            return True
    return False


def message_words(segment: str) -> list[str]:
    """Lower-cased words; what has a digit is a number."""
    words = []
    for token in segment.translate(_SPLIT).lower().replace("java script", "javascript").split():
        word = token.strip(".,;:!?'…¿¡*#-–—=")
        if word[1:2] == "'" and len(word) > 2:  # an elided article or pronoun
            word = word[2:]
        if word:
            words.append("0" if any(map(str.isdigit, word)) else word)
    if not NEGATIONS.isdisjoint(words):
        words = ["not-" + w if w in NEGATED else w for w in words]
    return words


def message_kind(words: list[str], numbers: list[str]) -> int:
    """The kind of message that nearly all words belong to, or -1."""
    if not TELLING.isdisjoint(words) or (words[:1] == ["we"] and OWN_FAILURE.isdisjoint(words)):
        return -1
    for k, kind in enumerate(KINDS):
        if _belongs(kind, words, numbers):
            return k
    return -1


def _belongs(kind: Kind, words: list[str], numbers: list[str]) -> bool:
    coded = any(n.isdigit() and len(n) == 3 and n[0] in "45" for n in numbers)
    met = [not core.isdisjoint(words) if kind.words == 1 else len(core.intersection(words)) >= kind.words for core in kind.cores]
    if kind.name == "error page" and coded and len(met) > 1:
        met = [True, any(met)]
    if not all(met):
        return False
    topical = [w for w in words if w != "0" and (w in kind.company or w not in PLAIN)]
    known = sum(map(kind.company.__contains__, topical))
    # Two different words at least, so that a word of two concepts is no message by itself.
    return known >= kind.least * len(topical) and (len(set(topical)) > 1 or coded)


def leading_message(segment: str) -> tuple[int, list[str]]:
    """The kind and words of a message with a status code or about scripts that another sentence follows without a stop."""
    tokens = _JAVA.sub("JavaScript", segment).split()
    for k, kind in enumerate(KINDS):
        if kind.words > 1 or kind.name == "filler":
            continue
        at = last = 0
        for i, token in enumerate(tokens):
            if i and not token[:1].islower():
                last = i
            at = i
            if any(w != "0" and w not in kind.company and w not in PLAIN for w in message_words(token)):
                break
        words = message_words(" ".join(tokens[:last]))
        if last <= at and words and (kind.name != "error page" or "0" in words):
            numbers = [t.strip(_SIGNS) for t in tokens[:last]]
            coded = any(n.isdigit() and len(n) == 3 and n[0] in "45" for n in numbers)
            if (coded or kind.name != "error page") and TELLING.isdisjoint(words) and _belongs(kind, words, numbers):
                return k, words
    return -1, []


def _template(kind: int, words: list[str]) -> tuple[int, int]:
    """A message's template, in which words that are not of its kind and numbers are slots; and all its words."""
    company, out = KINDS[kind].company, [str(kind)]
    for w in words:
        part = w if w in company or w in PLAIN else "_"
        if out[-1] != part or part != "_":
            out.append(part)
    return _hash(" ".join(out)), _hash(" ".join(words))


Slot = tuple[int, int, int, int, bool, bool]


def examine(
    text: str | None, frame: frozenset[str]
) -> tuple[bool, list[tuple[int, int]], list[Slot], list[tuple[int, int, int]], int | None]:
    """Whether an address lacks its name; skeletons of segments; slots looked at; messages; its hash as a page."""
    if not text or text.isspace():
        return False, [], [], [], None
    body = _QUOTED.sub("", text) if "`" in text else text
    low = body.lower()
    segments = [s for s in _SEGMENTS.split(body) if s and not s.isspace()]
    marks = _MARKS.search(body) is not None
    unset = ("undefined" in low or "null" in low or "nan" in low or "none" in low or "nil" in low) and UNSET.search(body) is not None
    certain = _NAMELESS.search(body) is not None or (unset and _SALUTATION.search(body) is not None)
    coded = _CODE.search(body) is not None
    aligned, slots, messages, spoken = set(), set(), set(), 0
    for s in segments:
        form, said, anchors = skeleton(s, frame)
        own = _hash(form), _hash(" ".join(said))
        if anchors >= ANCHORS:
            aligned.add(own)
        marked = marked_slots(s) if marks else []
        doubtful = unset_slots(s) if unset else []
        for spans, prose in ((marked, False), (doubtful, True)):
            for a, b in spans:
                bare, _, _ = skeleton(s[:a] + " " + s[b:], frame)
                told = prose or not _ABOUT.isdisjoint(said)
                slots.add((own[0], _hash(bare), _hash(s[a:b].lower()), own[1], anchors >= ANCHORS, told))
        spoken += not (_PARTS.isdisjoint(said) and _SPEECH.isdisjoint(said))
        if _HINTS.isdisjoint(said) and "<" not in s:
            continue
        words = message_words(s)
        if latin_filler(words) or stutter(words):
            messages.add((len(KINDS), *_template(len(KINDS) - 1, words)))
        elif _LOGGED.match(s) is None:
            numbered = coded and _CODE.search(s) is not None
            kind = message_kind(words, [t.strip(_SIGNS) for t in s.split()] if numbered else [])
            if kind < 0 and (numbered or not SCRIPTS.isdisjoint(words)):
                kind, words = leading_message(s)
            if kind >= 0:
                messages.add((kind, *_template(kind, words)))
    page = None
    if not messages and spoken > PAGE_SHARE * len(segments):
        every = set(message_words(body))
        if not _PARTS.isdisjoint(every) and not _SPEECH.isdisjoint(every):
            page = _hash(" ".join(_NUMBERS.sub("0", low).split()))
    return certain, sorted(aligned), sorted(slots), sorted(messages), page


def _structs(lists: list[list[tuple]], names: list[str], flags: int = 0, first: pa.DataType | None = None) -> pa.Array:
    """Lists of tuples as lists of structs, without a Python object for each struct; the last ``flags`` fields are booleans."""
    ends = np.cumsum([0, *map(len, lists)])
    flat = np.array([t for rows in lists for t in rows], np.int64).reshape(-1, len(names))
    columns = [pa.array(flat[:, i]) for i in range(len(names) - flags)]
    columns += [pa.array(flat[:, i].astype(bool)) for i in range(len(names) - flags, len(names))]
    if first is not None:
        columns[0] = columns[0].cast(first)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, names))


def frame_words(common_words: DataFrame) -> frozenset[str]:
    """The function words of all languages: a table of settings."""
    return frozenset(r[0] for r in common_words.where(F.col("word").isNotNull()).select(F.lower("word")).distinct().collect())


def examined(documents: DataFrame, common_words: DataFrame) -> DataFrame:
    """One row of SCHEMA per document."""
    frame = frame_words(common_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [examine(t, frame) for t in batch["text"].to_pylist()]
            arrays = [
                batch["doc_id"],
                pa.array([f[0] for f in found], pa.bool_()),
                _structs([f[1] for f in found], ["skeleton", "words"]),
                _structs([f[2] for f in found], ["skeleton", "bare", "value", "words", "anchored", "prose"], 2),
                _structs([f[3] for f in found], ["kind", "template", "words"], 0, pa.int32()),
                pa.array([f[4] for f in found], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "certain", "aligned", "slots", "messages", "page"])

    return spread(documents.select("doc_id", "text"), "doc_id").mapInArrow(run, SCHEMA)


def slot_residue(found: DataFrame) -> DataFrame:
    """``doc_id, reason`` of slots that keep a marked identifier, a default or an unset value."""
    slots = found.select("doc_id", F.inline("slots"))
    # Pre-aggregated before it is exchanged, so a template of a third of all rows is a few rows a task.
    held = slots.groupBy("skeleton", "value").agg(F.countDistinct("words").alias("same"))
    keys = slots.where("anchored").select(F.explode(F.array("skeleton", "bare")).alias("skeleton")).distinct()
    segments = found.select(F.inline("aligned")).distinct().join(keys.hint("merge"), "skeleton", "left_semi")
    different = segments.groupBy("skeleton").agg(F.count(F.lit(1)).alias("all"))
    judged = (
        slots.join(held.hint("merge"), ["skeleton", "value"])
        .join(different.hint("merge"), "skeleton", "left")
        .join(different.select(F.col("skeleton").alias("bare"), F.col("all").alias("without")).hint("merge"), "bare", "left")
    )
    others = F.coalesce(F.col("all"), F.lit(0)) - F.col("same")
    constant = F.col("prose") & F.col("anchored") & (F.col("same") >= SUPPORT) & (F.col("same") >= CONSTANT_SHARE * F.col("all"))
    filled = F.col("anchored") & ((others > 0) | ((F.col("bare") != F.col("skeleton")) & F.col("without").isNotNull()))
    reason = F.when(filled, "slot that aligned records fill").otherwise("marked or unset value without aligned records")
    return judged.where(~F.coalesce(constant, F.lit(False))).select("doc_id", reason.alias("reason"))


def message_residue(found: DataFrame) -> DataFrame:
    """``doc_id, reason`` of messages; those whose template stands in several records are told apart."""
    rows = found.select("doc_id", F.inline("messages"))
    templates = rows.groupBy("template").agg((F.min("doc_id") != F.max("doc_id")).alias("recurs"))
    names = F.array(*[F.lit(k.name) for k in KINDS], F.lit("filler"))
    reason = F.concat(F.element_at(names, F.col("kind") + 1), F.when(F.col("recurs"), " of a repeated template").otherwise(""))
    return rows.join(templates.hint("merge"), "template").select("doc_id", reason.alias("reason"))


def repeated_pages(found: DataFrame) -> DataFrame:
    pages = found.where(F.col("page").isNotNull()).select("doc_id", "page")
    repeated = pages.groupBy("page").agg(F.count(F.lit(1)).alias("records")).where(F.col("records") >= SUPPORT)
    return pages.join(repeated.hint("merge"), "page", "left_semi").select("doc_id", F.lit("repeated page").alias("reason"))


def residue(documents: DataFrame, common_words: DataFrame) -> DataFrame:
    """``doc_id`` and ``reason`` of every record with residue, a row for each reason."""
    found = cut(examined(documents, common_words))
    nameless = found.where("certain").select("doc_id", F.lit("address without a name").alias("reason"))
    return nameless.unionByName(slot_residue(found)).unionByName(message_residue(found)).unionByName(repeated_pages(found)).distinct()

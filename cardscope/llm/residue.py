"""Template residue and error-page text, by positive-unlabelled naive Bayes.

A record is cut into passages. Passages of a few generic forms (an HTTP status, an error payload, a call to enable JavaScript, a
placeholder of a template language, Latin filler, one word over and over) are trusted positives; all others are unlabelled. Naive
Bayes is fitted to both by expectation-maximisation: unlabelled passages start as negative and are re-weighted by their
posterior in every round. Every passage of every record is then scored, and a record is residue when one of its passages is.

In the first round every unlabelled passage counts as negative. One that stands word for word in several records would there outvote
the words it shares with others, so its features that no other passage has are left out of its first odds.

Text in quotation marks, back-ticks or code is spoken about, not shown; it is replaced by a mark before anything else, which
makes its passage one that tells: a known negative of the fit, and residue only by its form. A whole line that is a payload
itself (`{"error": …`, `<html>…`) is not quoting.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardscope.session import cut_lineage

#: Hashed features of the classifier; at most so many weights are broadcast.
FEATURES = 1 << 18
#: Documents that the classifier is fitted to, at most; which ones is decided by a hash of the whole text.
FIT_DOCUMENTS = 40_000
#: Occurrences from which a passage counts as repeated.
REPEATED = 3
#: Passages of one document that the classifier is fitted to, and characters of each, at most; all are scored whole.
FIT_PASSAGES, FIT_CHARS = 200, 1000
#: Log odds beyond which a passage is residue, and the largest prior odds that a fit may find.
THRESHOLD, MOST_PRIOR = 3.0, 0.25

# Notations of placeholders, one each.
_PLACEHOLDERS = (
    ("curly", r"\{\{\{?[^{}\n]{1,60}\}?\}\}"), ("dollar", r"\$[{(]\s*[A-Za-z_]\w*\s*[)}]"), ("dollars", r"(?<![\w$])\$[A-Za-z_]\w*\$"), ("hash", r"#\{[^{}\n]{1,40}\}"),
    ("erb", r"<%=?[^%\n]{1,60}%>"), ("block", r"\{%[^%\n]{1,60}%\}"), ("at", r"@@\w+@@"), ("under", r"(?<!\w)__[A-Za-z]\w*?__(?!\w)"),
    ("square", r"\[\[[^\[\]\n]{1,60}\]\]"), ("angles", r"<<[^<>\n]{1,60}>>"), ("merge", r"\*\|\w+\|\*"), ("escaped", r"&lt;[^&\n]{1,60}&gt;"),
    ("percents", r"(?<![\w%])%%?[A-Za-z_]\w*%%?(?!\w)"), ("pyformat", r"%\(\w+\)[sd]"), ("smarty", r"\{\$\w+\}"),
    ("brace", r"(?<![\w\\$#%{])\{[A-Za-z_]\w*\}(?!\})"), ("number", r"(?<![\w\\$#%{])\{\d\}(?!\})"), ("printf", r"(?<![\w%])%[sd](?!\w)"), ("crosses", r"(?<!\w)[Xx]{3,}(?!\w)"),
    ("blank", r"(?<!\w)_{4,}(?!\w)"),
)
# Slots that say what to put there, between brackets.
_SLOT_WORDS = (
    ("insert", r"(?:insert|insertar|ins[eé]rer|todo|tbd|your|nombre|nom|name|date|title|column|placeholder)\b[^\[\]<>\n]{0,60}"),
    ("here", r"[^\[\]<>\n]{1,60}\b(?:goes here|here|eintragen|einf[uü]gen|aqu[ií]|ici)"),
)
_SURE = ("curly", "dollar", "hash", "erb", "block", "at", "under", "square", "merge", "escaped", "pyformat", "smarty", "insert", "here", "angles", "dollars", "percents")
# Generic forms that are trusted, from the start of a passage: status codes, payloads, script notices, repetition.
_FORMS = (
    r"(?:http|error|fehler|erreur|status)\W{0,2}(?:code\W{0,2})?[45]\d\d\b", r"[45]\d\d\W{1,3}(?:bad request|unauthorized|forbidden|not found|internal server error|bad gateway|service unavailable|gateway time-?out)\W*$",
    r"(?:internal server error|bad gateway|service unavailable|gateway time-?out)\W*$", r'\{\s*"error"\s*:', r"<error\b", r"<html\b", r"traceback \(most recent call last\)", r"fatal error:",
    r"(?:(?:please|you must|you need to|bitte|veuillez|por favor),? )?(?:enable|activate|allow|turn on|switch on|aktivieren sie|activer|activez|active|activar) (?:java)?script(?:s|ing)?\b", r"javascript is (?:disabled|required)\b", r"(\w+)(?:\W+\1){2,7}\b(?!\W+\1\b)",
)
_CHAT = re.compile(r"^\s*(?:\[\d{1,2}:\d{2}\]\s*\w+:\s*|[-*>]\s+|#+\s+|\*\*)")
_FENCE = re.compile(r"```.*?(?:```|\Z)", re.S)
_QUOTES = re.compile(r'`[^`\n]*`|"[{<].*[}>]"|\'[{<].*[}>]\'|"[^"\n]*"|“[^”\n]*”|„[^“”\n]*[“”]|«[^»\n]*»|(?<!\w)\'[^\'\n]*\'(?!\w)')
_PAYLOAD = re.compile(r"^\s*(?:\{\"|<\w|<!|Traceback|  File \"|KeyError)", re.I)
_SENTENCE = re.compile(r"(?<=[.!?…])\s+(?=[^\s])")
_MARKS = re.compile("|".join(f"(?P<{n}>{p})" for n, p in _PLACEHOLDERS), re.I)
_TRUSTED = re.compile("|".join(_FORMS), re.I)
_SLOTS = re.compile(r"[\[<](?:" + "|".join(f"(?P<{n}>{p})" for n, p in _SLOT_WORDS) + r")[\]>]", re.I)
# how placeholders begin; without regard to case a search is far slower, so both cases are named
_MAY_MARK, _MAY_QUOTE = re.compile(r"\{|\$[{(A-Za-z_]|%[%A-Za-z_(]|@@|__|<[<%]|\[\[|\*\||&[lL][tT];|[xX]{3}"), re.compile("[`\"'“„«]")
# Beginnings of the words of the usual Latin filler text.
_FILLER = frozenset("lore ipsu dolo sit amet cons adip elit sed eius temp inci labo magn aliq enim mini veni quis nost exer ulla nisi comm duis aute irur repr volu veli esse cill fugi null pari exce sint occa cupi non proi sunt culp qui offi dese moll anim est ut et in ex ea id".split())
_WORD = re.compile(r"[^\W\d_]+|\d+|§\w+")
_DIGIT = re.compile(r"[1-9]")


def _marked(m: re.Match) -> str:
    return f" §{m.lastgroup} "


def passages_of(text: str | None) -> list[str]:
    """Sentences of the lines of a text, with quoted text replaced by §quote, code by §code and placeholders by §<notation>."""
    if not text:
        return []
    out = []
    text = text.replace("\xa0", " ")
    for line in (_FENCE.sub("\n§code\n", text) if "```" in text else text).split("\n"):
        line = line.strip()
        if line and line[0] in "[-*>#":
            line = _CHAT.sub("", line).strip()
        if not line:
            continue
        if _MAY_QUOTE.search(line) and not _PAYLOAD.match(line):
            line = _QUOTES.sub(" §quote ", line)
        if not line.startswith("<html"):
            if ("[" in line or "<" in line) and _SLOTS.search(line):
                line = _SLOTS.sub(_marked, line)
            if _MAY_MARK.search(line):
                line = _MARKS.sub(_marked, line)
        out += [p.strip() for p in _SENTENCE.split(line) if p.strip()]
    return out


def is_filler(words: list[str]) -> bool:
    """Whether at least five words and seven in ten are Latin filler; words in lower case."""
    return len(words) >= 5 and sum(w[:4] in _FILLER for w in words) >= 0.7 * len(words)


def is_trusted(passage: str, words: list[str] | None = None) -> bool:
    """Whether a passage has one of the generic forms: a sure placeholder, filler, a status, payload or notice. None with quotes."""
    if quotes(passage):
        return False
    if _TRUSTED.match(passage) or "§" in passage and any(f"§{n}" in passage for n in _SURE):
        return True
    return is_filler(_words(passage) if words is None else words)


def quotes(passage: str) -> bool:
    """Whether a passage holds quoted text or code: what it says is told, not shown."""
    return "§quote" in passage or "§code" in passage


def _names(passage: str) -> set:
    """The features of a passage by name: words, and pairs of neighbouring words. Numbers count by their length, marks of quotes
    and code not at all."""
    words = _words(passage)
    return {*words, *zip(words, words[1:])}


def _words(passage: str) -> list[str]:
    words = [w if not w.isdigit() else f"0{len(w)}" for w in _WORD.findall(passage.lower())]
    return [w for w in words if w != "§quote" and w != "§code"] if "§" in passage else words


def _slot(name: str | tuple[str, str]) -> int:
    return zlib.crc32((name if isinstance(name, str) else " ".join(name)).encode()) % FEATURES


def features_of(passage: str) -> np.ndarray:
    """The hashed features of a passage."""
    return np.array(sorted(map(_slot, _names(passage))), dtype=np.int32)


class Scorer:
    """Log odds of passages under fitted weights, and whether they are filler; remembers the weights of features and the verdicts
    on passages, but for their digits, that it met last. A passage without words speaks for nothing."""

    def __init__(self, weights: np.ndarray, remember: int = 500_000) -> None:
        self.weights, self.prior, self.remember = weights, float(weights[-1]), remember
        self.known: dict = {}
        self.judged: dict[str, tuple[float, bool]] = {}

    def judge(self, passage: str) -> tuple[float, bool]:
        """(log odds, whether the passage is trusted); one that quotes tells, whatever its words."""
        if quotes(passage):
            return -np.inf, False
        key = _DIGIT.sub("0", passage)
        found = self.judged.get(key)
        if found is None:
            if len(self.judged) >= self.remember // 4:
                self.judged.clear()
            words = _words(key)
            found = self.judged[key] = (self._score(words), is_trusted(key, words))
        # of the forms, only status codes read digits
        return found if found[1] or key == passage else (found[0], bool(_TRUSTED.match(passage)))

    def __call__(self, passage: str) -> float:
        return self.judge(passage)[0]

    def _score(self, words: list[str]) -> float:
        if not words:
            return -np.inf
        total, known = self.prior, self.known
        for name in {*words, *zip(words, words[1:])}:
            w = known.get(name)
            if w is None:
                if len(known) >= self.remember:
                    known.clear()
                w = known[name] = float(self.weights[_slot(name)])
            total += w
        return total


def fit(trusted: list[np.ndarray], unlabelled: list[np.ndarray], counts: np.ndarray | None = None, told: np.ndarray | None = None, rounds: int = 8, mixed: float = 0.02) -> np.ndarray:
    """Weights by feature, with the log prior odds last.

    trusted, unlabelled: the features of passages; counts: how often each unlabelled one occurs; told: which of them are known
    to speak about residue, and stay negative. The feature frequencies of
    both classes are mixed with those of everything (a share `mixed`), so a feature unseen in both speaks for neither, however
    unequal the classes are, and one seen among unlabelled passages only speaks clearly against. Unlabelled passages start as
    negative; in the first round what only one passage says counts for nothing if it occurs REPEATED times or more. Without trusted passages every weight is 0 and the
    prior forbids residue.
    """
    weights = np.zeros(FEATURES + 1)
    if not trusted:
        weights[-1] = -np.inf
        return weights
    counts = np.ones(len(unlabelled)) if counts is None else counts
    pf = np.concatenate(trusted) if trusted else np.zeros(0, np.int32)
    uf = np.concatenate(unlabelled) if unlabelled else np.zeros(0, np.int32)
    ui = np.repeat(np.arange(len(unlabelled)), [len(x) for x in unlabelled])
    sure = np.bincount(pf, minlength=FEATURES).astype(float)
    every = sure + np.bincount(uf, counts[ui], minlength=FEATURES)
    total = max(every.sum(), 1.0)

    common = mixed * (every + 1e-3) / total
    # a passage that stands in several records is its own only witness where no other says the same
    own = ((np.bincount(uf, minlength=FEATURES) + (sure > 0) < 2)[uf]) & (counts[ui] >= REPEATED)
    posterior = np.zeros(len(unlabelled))
    for turn in range(rounds):
        mass = posterior * counts
        pos, neg = sure + np.bincount(uf, mass[ui], minlength=FEATURES), np.bincount(uf, (counts - mass)[ui], minlength=FEATURES)
        p, n = ((1 - mixed) * c / max(c.sum(), 1.0) + common for c in (pos, neg))
        weights[:-1] = np.log(p / n)
        weights[-1] = np.log(min((len(trusted) + mass.sum()) / max((counts - mass).sum(), 1.0), MOST_PRIOR))
        said = np.where(own, 0.0, weights[uf]) if turn == 0 else weights[uf]
        odds = np.bincount(ui, said, minlength=len(unlabelled)) + weights[-1]
        posterior = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
        if told is not None:
            posterior[told] = 0.0
    return weights


def score(passage: str, weights: np.ndarray) -> float:
    """Log odds that the passage is residue."""
    return Scorer(weights)(passage)


def fit_on(documents: DataFrame, text_col: str = "text", fit_documents: int = FIT_DOCUMENTS) -> np.ndarray:
    """Weights fitted on the distinct passages of at most about fit_documents documents, chosen by a hash of the text. Passages
    that differ in case or digits only are one. Those of one document are at most FIT_PASSAGES, and FIT_CHARS of each, so the fit is
    bounded; whether a passage is trusted is decided on the whole of it. Features are made by the executors."""
    texts = documents.select(F.col(text_col).alias("text")).where("text is not null and text <> ''")
    total = texts.count()
    if total > fit_documents:
        # the hash is spread over 2^53 values, so any number of documents leaves a share of it
        part = F.shiftrightunsigned(F.xxhash64("text", F.lit("fit")), 11)
        texts = texts.where(part < int(2**53 * fit_documents / total))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [p for t in batch.column(0) for p in passages_of(t.as_py())[:FIT_PASSAGES]]
            cols = [pa.array([_DIGIT.sub("0", p).lower()[:FIT_CHARS] for p in found], pa.string()), pa.array([is_trusted(p) for p in found], pa.bool_())]
            yield pa.RecordBatch.from_arrays(cols, ["passage", "trusted"])

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [p.as_py() for p in batch.column(0)]
            cols = [pa.array([features_of(p).tolist() for p in found], pa.list_(pa.int32())), pa.array([quotes(p) for p in found], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], ["passage", "count", "trusted", "features", "told"])

    seen = texts.mapInArrow(run, "passage string, trusted boolean").groupBy("passage").agg(F.count("*").alias("count"), F.bool_or("trusted").alias("trusted"))
    # ordered first: the samples of a sort would make the features once more
    rows = seen.orderBy("passage").mapInArrow(named, "passage string, count bigint, trusted boolean, features array<int>, told boolean").drop("passage").toPandas()
    trusted, rest, counts, told = [], [], [], []
    for f, n, sure, tells in zip(rows["features"], rows["count"], rows["trusted"], rows["told"]):
        f = np.asarray(f, dtype=np.int32)
        if sure:
            trusted += [f] * min(int(n), 3)
        else:
            rest.append(f)
            counts.append(float(n))
            told.append(tells)
    return fit(trusted, rest, np.array(counts), np.array(told, dtype=bool))


def residue_passages(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", weights: np.ndarray | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """(id, score, trusted, passage): the passage of each residue document that speaks most for it.

    A document is residue when a passage is trusted or scores above threshold. Null and empty texts are none. Equal texts
    get equal answers, rows delivered twice come out twice. Map-side, whole texts.
    """
    weights = fit_on(documents, text_col) if weights is None else weights
    shared = documents.sparkSession.sparkContext.broadcast(weights.astype(np.float32))
    id_type = documents.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            at, best, sure, which = [], [], [], []
            for n, text in enumerate(batch.column(1)):
                judged = [(*scorer.judge(p), p) for p in passages_of(text.as_py())]
                judged = [j for j in judged if j[1] or j[0] > threshold]
                if judged:
                    top = max(judged, key=lambda j: (j[1], j[0]))
                    at.append(n), best.append(top[0]), sure.append(top[1]), which.append(top[2])
            ids = batch.column(0).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(best, pa.float64()), pa.array(sure, pa.bool_()), pa.array(which, pa.string())], [id_col, "score", "trusted", "passage"])

    texts = documents.select(F.col(id_col), F.col(text_col)).where(F.col(text_col).isNotNull() & (F.col(text_col) != ""))
    return texts.mapInArrow(run, f"{id_col} {id_type}, score double, trusted boolean, passage string")


def residue_records(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id): the documents to exclude; each once."""
    return residue_passages(documents, id_col, text_col, **options).select(id_col).distinct()


def without_residue(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """documents without those that residue_records names; rows with a null id are judged together and kept."""
    bad = cut_lineage(residue_records(documents, id_col, text_col, **options))
    return documents.join(bad, id_col, "left_anti")

"""Personal data by weak supervision.

Base patterns give spans that always stay. Wider patterns propose further candidates of the same kinds: phone numbers
without a plus sign, addresses that spell out the at sign or the dots or mask some letters with asterisks, card numbers
that only fail the length or the check digit. Every candidate, base or not, is voted on by labelers: regular expressions and checksums, gazetteers of
domain endings, number prefixes and reserved ranges, and words of the context. The votes of all candidates are counted
by pattern (a bounded table, however large the corpus); expectation-maximisation on the counts estimates each labeler's
reliability for each kind and the probability of each pattern; a logistic classifier of the votes, trained on those probabilities,
decides which candidates become spans.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

KINDS = ("email", "ip", "card", "phone")
RANK = {k: i for i, k in enumerate(KINDS)}
CUT = 0.9
CONTEXT = 40

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")  # as the contract's pattern: no match begins within a run of digits
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A spelled-out at sign, a dot of a domain as it may be spelled, and what may follow the at sign.
_AT = re.compile(r"[(\[{][aA][tT][)\]}]| [aA][tT] ")
_DOT = re.compile(r" ?(?:\(dot\)|\[dot\]|\{dot\}) ?| dot |\.", re.I)
_SPELLED = re.compile(rf" ?[A-Za-z0-9-]+(?:(?:{_DOT.pattern})[A-Za-z0-9-]+)+", re.I)
_STARRED = re.compile(r"[A-Za-z0-9*-]+(?:\.[A-Za-z0-9*-]+)+")
_WIDE = {
    "phone": re.compile(r"(?:\(0?[0-9]{2,4}\) ?|00[0-9]{1,3}[ -])[0-9][0-9 -]{4,12}[0-9]"),
}
# Endings of domains, leading digits of card issuers, country calling codes, words of the context.
ENDINGS = frozenset("com org net edu gov mil int info biz io co de fr es it uk us ca eu ch at nl be pt br jp cn in au ru pl se no fi dk ie".split())
ISSUERS = ("34", "37", "30", "36", "38", "4", "51", "52", "53", "54", "55", "6011", "62", "65", "2221", "2720")
CALLING = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "52", "55", "61", "81", "82", "86", "91", "351", "353", "358")
HINTS = {
    "email": re.compile(r"mail|contact|write|address|kontakt|correo|courriel|adresse", re.I),
    "ip": re.compile(r"\bip\b|address|host|server|login|adresse|client", re.I),
    "card": re.compile(r"card|visa|master|credit|payment|karte|tarjeta|carte|konto|account", re.I),
    "phone": re.compile(r"phone|\btel|call|mobile|fax|telefon|tel[eé]fono|m[oó]vil|portable", re.I),
}
AGAINST = re.compile(r"version|token|hash|sha|isbn|issn|doi|http|/|=|\bid\b|#", re.I)
#: Votes of one candidate: shape, checksum, gazetteer, context, surroundings; each 0 (against), 1 (abstains), 2 (for).
LABELERS = 5
CHECKSUM = 1
#: Imagined votes, as a multiple of a kind's candidates: of each labeler, and of that of check digits and lengths.
IMAGINED = (0.2, 5.0)


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(d * 2 - 9 * (d > 4) for d in map(int, even))) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local@domain: only the runs before an @ sign can begin one."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The contract's spans: leftmost non-overlapping matches of each kind, those that fail the kind's test dropped."""
    out = [("email", s, e) for s, e in _emails(text)]
    if not text.isascii() or any(d in text for d in "0123456789"):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m.group().split(".")):
                out.append(("ip", *m.span()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                d = m.group().replace(" ", "").replace("-", "")
                if 14 <= len(d) <= 19 and luhn(d):
                    out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(c in "0123456789" for c in m.group()) <= 15:
                out.append(("phone", *m.span()))
    return sorted(out, key=lambda x: (x[1], RANK[x[0]], x[2]))


def _wide_emails(text: str) -> Iterator[tuple[int, int]]:
    """Addresses with a spelled-out at sign, or with asterisks: only the runs before an at sign can begin one."""
    for m in _AT.finditer(text):
        last = m.start() - (text[m.start() - 1 : m.start()] == " ")
        start = last
        while start and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        domain = _SPELLED.match(text, m.end()) if start < last else None
        if domain:
            yield start, domain.end()
    at = text.find("@") if "*" in text else -1
    while at >= 0:
        start = at
        while start and (text[start - 1] in _LOCAL_CHARS or text[start - 1] == "*"):
            start -= 1
        domain = _STARRED.match(text, at + 1) if start < at else None
        if domain and "*" in text[start : domain.end()]:
            yield start, domain.end()
        at = text.find("@", at + 1)


def _wide_spans(text: str) -> Iterator[tuple[str, int, int]]:
    for start, end in _wide_emails(text):
        yield "email", start, end
    if "(" in text or "00" in text:
        for m in _WIDE["phone"].finditer(text):
            if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
                yield "phone", *m.span()
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            d = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(d) <= 19:
                yield "card", *m.span()


def votes(text: str, kind: str, start: int, end: int, base: bool) -> int:
    """The labelers' votes as one number in base 3."""
    s = text[start:end]
    d = "".join(c for c in s if c in "0123456789")
    before, after = text[max(0, start - CONTEXT) : start], text[end : end + 1]
    shape = 2 if base else 1
    checksum = 1
    if kind == "card":
        shape = 2 if len(d) in (15, 16) else 1
        checksum = 2 if luhn(d) else 0
        listed = 2 if d.startswith(ISSUERS) else 0
    elif kind == "email":
        listed = 2 if _DOT.split(s)[-1].lower() in ENDINGS else 0
        if not base:  # " at " before a domain that is written out may be plain prose
            checksum = 2 if "@" in s or any(c in s for c in "([{") or re.search(" dot ", s, re.I) else 0
    elif kind == "ip":
        first = int(d and s.split(".")[0] or 0)
        listed = 0 if first == 0 or first >= 224 else 2
    else:
        d = d[2:] if s.startswith("00") else d
        listed = (2 if d.startswith(CALLING) else 0) if s[0] in "+0" else 1
        checksum = 2 if 10 <= len(d) <= 15 else 0 if s[0] in "+0" else 1  # the digits of an international number
    context = 2 if HINTS[kind].search(before) else 0 if AGAINST.search(before[-12:]) else 1
    glued = (start and (text[start - 1].isalnum() or text[start - 1] in ".-_")) or after.isalnum() or after in ("-", "_", "/") and after != ""
    around = 0 if glued else 2
    code = 0
    for v in (shape, checksum, listed, context, around):
        code = code * 3 + v
    return code


def _net(code: int) -> int:
    """Votes for less votes against."""
    return sum(code // 3**i % 3 - 1 for i in range(LABELERS))


def candidates(text: str) -> list[tuple[str, int, int, bool, int]]:
    """(kind, start, end, base, votes): base spans, and wider candidates that overlap none of them or each other."""
    base = base_spans(text)
    out = [(k, s, e, True, votes(text, k, s, e, True)) for k, s, e in base]
    taken = sorted((s, e) for _, s, e in base)
    wide = [(s, -e, votes(text, k, s, e, False), k) for k, s, e in set(_wide_spans(text))]
    i, free = 0, 0
    for s, e, code, k in sorted(wide, key=lambda x: (*x[:2], -_net(x[2]), RANK[x[3]])):  # of equal spans the better vote
        e = -e
        while i < len(taken) and taken[i][1] <= s:
            i += 1
        if s >= free and not any(a < e for a, _ in taken[i : i + 1]):
            out.append((k, s, e, False, code))
            free = e
    return out


def digits_of(code: np.ndarray) -> np.ndarray:
    return np.stack([code // 3**i % 3 for i in reversed(range(LABELERS))], 1)


def reliabilities(code: np.ndarray, base: np.ndarray, count: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Probability that each vote pattern is personal data, by expectation-maximisation on the patterns' counts.

    It starts from what the base patterns say; neither they nor any vote has a fixed say after that. ``IMAGINED`` votes
    are those of labelers that are right more often than not, and for check digits and lengths, which no true number
    fails, nearly always; they keep a kind of few true candidates from turning around.
    """
    v = digits_of(code)
    p = np.where(base, 0.9, np.where((v == 2).sum(1) > (v == 0).sum(1), 0.5, 0.1))
    total = count.sum()
    for _ in range(rounds):
        share = np.clip((p @ count) / total, 0.01, 0.99)
        logit = np.full(len(code), np.log(share / (1 - share)))
        for j in range(LABELERS):
            wrong = 0.001 if j == CHECKSUM else 0.1
            imagined = np.array([wrong, 0.5, 0.5 - wrong]) * (IMAGINED[j == CHECKSUM] * total + 1)
            for_ = np.bincount(v[:, j], p * count, 3) + imagined
            against = np.bincount(v[:, j], (1 - p) * count, 3) + imagined[::-1]
            logit += np.log(for_ / for_.sum() / (against / against.sum()))[v[:, j]] * (v[:, j] != 1)
        p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    return p


def classifier(code: np.ndarray, count: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Weights of a logistic model of the votes, trained on soft labels by Newton steps."""
    x = span_features(code)
    w = np.zeros(x.shape[1])
    weight = count / count.sum()
    for _ in range(100):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        curve = (x * (weight * q * (1 - q))[:, None]).T @ x + 1e-4 * np.eye(x.shape[1])
        step = np.linalg.solve(curve, x.T @ (weight * (p - q)) - 1e-4 * w)
        w += step * min(1.0, 2 / max(1e-12, np.abs(step).max()))
    return w


def span_features(code: np.ndarray) -> np.ndarray:
    v = digits_of(code)
    return np.concatenate([np.ones((len(code), 1)), v == 2, v == 0], 1).astype(float)


def fit(counts: list[tuple[str, bool, int, int]]) -> dict[str, np.ndarray]:
    """Classifier of each kind that has candidates, however few, from their (kind, base, votes, count)."""
    out = {}
    for kind in KINDS:
        own = sorted((b, c, n) for k, b, c, n in counts if k == kind)
        if own:
            base, code, n = (np.array(x) for x in zip(*own))
            out[kind] = classifier(code, n.astype(float), reliabilities(code, base.astype(bool), n.astype(float)))
    return out


def probability(model: dict[str, np.ndarray], kind: str, code: int) -> float:
    """The classifier's probability that a candidate of these votes is personal data."""
    return 1 / (1 + np.exp(-float(np.clip(span_features(np.array([code])) @ model[kind], -30, 30)[0]))) if kind in model else 0.0


def accepts(model: dict[str, np.ndarray], kind: str, code: int, base: bool, cut: float = CUT) -> bool:
    """Base spans stay; of all others the classifier decides."""
    return base or probability(model, kind, code) >= cut


_SPAN = "array<struct<kind:string,start:long,end:long,base:boolean,votes:int>>"
_ARROW_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("votes", pa.int32())]))


def candidate_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans) of every row: all candidates of the whole text with their votes."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[dict(zip(("kind", "start", "end", "base", "votes"), c)) for c in candidates(t or "")] for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(found, _ARROW_SPAN)], ["id", "spans"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(kernel, f"id long, spans {_SPAN}")


def vote_counts(found: DataFrame) -> list[tuple[str, bool, int, int]]:
    """Counts of the vote patterns of all candidates: at most 4 kinds x 2 x 3**5 rows."""
    rows = found.select(F.explode("spans").alias("s")).groupBy("s.kind", "s.base", "s.votes").count().collect()
    return [tuple(r) for r in rows]


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cut: float = CUT) -> DataFrame:
    """(id, base, spans) of every row, both arrays of (kind, start, end) by start, then kind.

    Offsets are code points, ends exclusive. Null and empty texts have no spans; very long texts are read whole, in time
    linear in their length; repeated rows stay repeated; an empty table gives no rows; other columns are ignored.
    """
    found = written(candidate_table(docs, id_col, text_col), "candidates")
    counts = vote_counts(found)
    model = fit(counts)
    good = sorted(f"{k}:{c}" for k, b, c, _ in counts if not b and accepts(model, k, c, b, cut))
    place = lambda s: F.struct(s["start"].alias("start"), F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).alias("rank"), s["kind"].alias("kind"), s["end"].alias("end"))
    own = lambda keep: F.array_sort(F.transform(F.filter("spans", keep), place))
    taken = lambda s: s["base"] | F.concat_ws(":", s["kind"], s["votes"].cast("string")).isin(good) if good else s["base"]
    return found.select("id", own(lambda s: s["base"]).alias("base"), own(taken).alias("spans"))


def masked(docs: DataFrame, text_col: str = "text", cut: float = CUT) -> DataFrame:
    """The documents with every span replaced by its kind in angle brackets; ``n_chars`` follows if it is there.

    Null and empty texts stay; very long texts are masked whole; repeated rows stay repeated; all columns are kept,
    whatever their names; an empty table gives no rows.
    """
    model = fit(vote_counts(candidate_table(docs.select(F.lit(None).cast("long").alias("doc_id"), F.col(text_col).alias("text")))))

    @F.pandas_udf("string")
    def mask(texts):  # noqa: ANN001, ANN202
        import pandas as pd

        out = []
        for t in texts:
            spans = sorted((s, e, k) for k, s, e, base, code in candidates(t or "") if accepts(model, k, code, base, cut))
            parts, at = [], 0
            for s, e, k in spans:
                if s >= at:
                    parts += [t[at:s], f"<{k}>"]
                at = max(at, e)
            out.append(t if not spans else "".join([*parts, t[at:]]))
        return pd.Series(out, dtype=object)

    out = docs.withColumn(text_col, mask(text_col))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length(text_col).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts and the digest are those of the base spans; ``spans`` also has what the method adds."""
    out = detect(table(spark, sf_dir, "documents"))
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of = lambda k: F.filter("base", lambda s: s["kind"] == k)
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in KINDS]
    return out.select(F.col("id").alias("doc_id"), *counts, F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"), joined("spans").alias("spans"))

"""Personal data by weak supervision: base detectors, labelers that vote, reliabilities by expectation-maximisation.

The base kinds (email, ip, card, phone) are found by pattern and check, and stay whatever the model says. Candidates for
further spans come from looser patterns. Labelers of three sorts vote for or against a candidate or abstain: patterns
(its strict shape, its checksum or mixture of characters), gazetteers (titles, given names, endings of hosts) and context
(key words before it, an assignment or quotes around it). What EM and the classifier learn from is the number of
candidates per kind and pattern of votes, counted over all documents in Spark: a table of bounded size. A two-class
Dawid-Skene model estimates each labeler's reliabilities from it; its posteriors are the soft labels of a logistic
classifier over kind, votes and length, which makes the final decision on each span.
"""

from __future__ import annotations

import bisect
import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import durable, lean

BASE = ("email", "ip", "card", "phone")
ADDED = ("secret", "number", "local_phone", "spelled_email", "person")
KINDS = BASE + ADDED
LABELERS = ("shape", "check", "gazetteer", "context", "framing")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
HOST = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a failed start inside a run of digits fails at each later digit of that run: starts at the run's head lose nothing
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LONG_TOKEN = re.compile(r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/-]{20,}={0,2}")
LOCAL_PHONE = re.compile(r"(?<![0-9+(.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])")
# parts have no greatest length; possessive repeats from the head of a run read each run once
SPELLED = re.compile(r"(?<![\w.-])[\w.-]++ ?[\[(] ?at ?[\])] ?[\w-]++(?: ?[\[(] ?dot ?[\])] ?[\w-]++)+")

#: Words that announce or make up personal data.
TITLES = ("Mr", "Mrs", "Ms", "Dr", "Prof", "Herr", "Frau", "Madame", "Monsieur", "Señor", "Señora", "Don", "Doña")
GIVEN = frozenset("Anna Maria Paul Peter John Mary James Robert Michael Linda David Susan Thomas Sarah Pierre Marie Jean Claire Hans Klaus Ursula Karin Jose Carmen Luis Juan Ana Pedro Carlos Lucia".split())
ENDINGS = frozenset("com org net edu gov io de fr es uk eu info".split())
CONTEXT = {
    "secret": ("token", "secret", "password", "passwd", "api_key", "apikey", "key", "bearer"),
    "number": ("card", "visa", "account", "iban", "konto", "compte", "cuenta", "ssn", "passport"),
    "local_phone": ("tel", "phone", "call", "fax", "mobile", "telefon", "téléphone", "teléfono"),
    "spelled_email": ("mail", "contact", "write", "kontakt", "correo"),
    "person": ("name", "dear", "by", "sincerely", "von", "par", "por"),
}
NAMED = re.compile(rf"(?<!\w)(?:{'|'.join(TITLES)})\.? ([A-ZÀ-Þ][\w'-]++)(?: ([A-ZÀ-Þ][\w'-]++))?")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches of the address pattern, found from each @ outward."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := HOST.match(text, at)):
            out.append((start, m.end()))
            end = m.end()
        else:
            end = max(end, at + 1)
        at = text.find("@", max(end, at + 1))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def digits_of(text: str) -> str:
    return re.sub(r"[^0-9]", "", text)


def small_parts(address: str) -> bool:
    return all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in address.split(".")))


def base_spans(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int]]]:
    """(spans of the base kinds by start and kind, runs of 14 to 19 digits that fail the checksum)."""
    found, failed = [(a, b, "email") for a, b in emails(text)], []
    if "." in text:
        found += [(m.start(), m.end(), "ip") for m in IP.finditer(text) if small_parts(m[0])]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := digits_of(m[0])) <= 19:
            if luhn(d):
                found.append((m.start(), m.end(), "card"))
            else:
                failed.append(m.span())
    if "+" in text:
        found += [(m.start(), m.end(), "phone") for m in PHONE.finditer(text) if 10 <= len(digits_of(m[0])) <= 15]
    return sorted(found, key=lambda s: (s[0], BASE.index(s[2]), s[1])), failed


def candidates(text: str, base: list[tuple[int, int, str]], failed: list[tuple[int, int]]) -> list[tuple[int, int, str, str]]:
    """Further spans (start, end, kind, votes) that overlap no base span, but may overlap each other; votes has + - or 0 per labeler."""
    raw = [(a, b, "number") for a, b in failed]
    raw += [(*m.span(), "secret") for m in LONG_TOKEN.finditer(text) if any("0" <= c <= "9" for c in m[0]) and any(c.isalpha() for c in m[0])]
    raw += [(*m.span(), "local_phone") for m in LOCAL_PHONE.finditer(text)]
    if "at" in text and ("[" in text or "(" in text):
        raw += [(*m.span(), "spelled_email") for m in SPELLED.finditer(text)]
    raw += [(*m.span(), "person") for m in NAMED.finditer(text)]
    if not raw:
        return []
    starts, ends = [], []  # the base spans' union
    for a, b in sorted(x[:2] for x in base):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    out = []
    for a, b, kind in sorted(raw, key=lambda s: (s[0], ADDED.index(s[2]))):
        i = bisect.bisect_right(ends, a)
        if i == len(ends) or starts[i] >= b:
            out.append((a, b, kind, votes(text, a, b, kind)))
    return out


def votes(text: str, a: int, b: int, kind: str) -> str:
    """What each of LABELERS says of the span."""
    span, before, after = text[a:b], text[max(0, a - 40) : a], text[b : b + 2]
    yes = lambda x, y=False: "+" if x else "-" if y else "0"
    words = re.findall(r"\w+", before.lower())[-4:]
    context = yes(any(k in words for k in CONTEXT[kind]))
    framing = yes(bool(re.search(r"[=:]\s*[\"']?$", before)) or (before[-1:] in "\"'<(" and before != "" and after[:1] in "\"'>)"))
    if kind == "secret":
        kinds = sum(bool(re.search(p, span)) for p in ("[0-9]", "[a-z]", "[A-Z]"))
        shape = yes(re.fullmatch(r"[0-9A-Fa-f]{32,}|[A-Za-z0-9_-]{24,}|[A-Za-z0-9+/]{32,}={0,2}", span), "/" in span)
        return shape + yes(len(set(span)) >= 10 and kinds >= 2, len(set(span)) < 8) + yes(span[:3] in ("sk-", "AKI", "ghp")) + context + framing
    if kind == "number":
        parts = re.split(r"[ -]", span)
        return yes(all(len(p) == 4 for p in parts) and len(parts) == 4, len(parts) > 5) + "-" + yes(span[0] in "3456" and len(digits_of(span)) == 16) + context + framing
    if kind == "local_phone":
        return yes(span[0] == "(" or span.count("-") == 2, "." in span) + yes(digits_of(span)[0] not in "01", True) + "0" + context + framing
    if kind == "spelled_email":
        return yes(re.search(r"dot", span), True) + yes(len(span) < 60, True) + yes(span.split()[-1].strip("])").lower() in ENDINGS) + context + framing
    names = [w for w in span.split()[1:]]
    return yes(len(names) == 2) + yes(all(len(w) > 2 for w in names), True) + yes(any(w in GIVEN for w in names)) + context + framing


def joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def detected(docs: DataFrame, kept: str, text: str) -> DataFrame:
    """Per row: its column `kept`, base (spans, joined), and its candidates: kinds, starts, ends, votes (arrays).

    text is a column, or with a dot a field of a struct column (of `kept`, so that it is sent once)."""
    column, *field = text.split(".", 1)

    @lean
    def run(batches):
        for batch in batches:
            base, kinds, starts, ends, said = [], [], [], [], []
            texts = batch.column(column)
            for t in (pc.struct_field(texts, field) if field else texts).to_pylist():
                spans, failed = base_spans(t or "")
                more = candidates(t or "", spans, failed)
                base.append(joined(spans))
                for out, i in ((starts, 0), (ends, 1), (kinds, 2), (said, 3)):
                    out.append([c[i] for c in more])
            ints, strings = pa.list_(pa.int32()), pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(kept), pa.array(base, pa.string()), pa.array(kinds, strings), pa.array(starts, ints), pa.array(ends, ints), pa.array(said, strings)], [kept, "base", "kinds", "starts", "ends", "votes"])

    strings, ints = T.ArrayType(T.StringType()), T.ArrayType(T.IntegerType())
    kinds = {"base": T.StringType(), "kinds": strings, "starts": ints, "ends": ints, "votes": strings}
    return docs.mapInArrow(run, T.StructType([docs.schema[kept], *(T.StructField(c, k) for c, k in kinds.items())]))


def size_class(length: int) -> int:
    return min(length.bit_length(), 7)


def reliabilities(votes_of: np.ndarray, kind: np.ndarray, n: np.ndarray, rounds: int = 100) -> np.ndarray:
    """Dawid-Skene EM: votes (-1, 0, 1) per pattern and labeler, kind and count per pattern -> P(personal) per pattern.

    Labelers have P(vote | class) of their own, kinds priors of their own; both are smoothed by a few pseudo-counts. It
    starts from the share of votes in favour.
    """
    p = np.clip(0.5 + 0.2 * votes_of.sum(axis=1), 0.05, 0.95)
    for _ in range(rounds):
        prior = np.array([(2 + (n * p)[kind == k].sum()) / (4 + n[kind == k].sum()) for k in range(len(ADDED))])
        log = np.stack([np.log(1 - prior[kind]), np.log(prior[kind])])
        for j in range(votes_of.shape[1]):
            for c, weight in enumerate((n * (1 - p), n * p)):
                # a labeler is believed to be right rather than wrong to begin with
                said = np.array([(1 + (v == (1 if c else -1)) * 2) + weight[votes_of[:, j] == v].sum() for v in (-1, 0, 1)], float)
                log[c] += np.log(said / said.sum())[votes_of[:, j] + 1]
        new = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
        if np.abs(new - p).max(initial=0) < 1e-6:
            return new
        p = new
    return p


def design(kind: np.ndarray, votes_of: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.concatenate([np.eye(len(ADDED))[kind], votes_of > 0, votes_of < 0, np.eye(8)[size]], axis=1).astype(float)


def logistic(x: np.ndarray, soft: np.ndarray, n: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Weights of a logistic classifier for soft labels, rows counted n times, a little ridge."""
    w, weight = np.zeros(x.shape[1]), n / max(n.sum(), 1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-x @ w))
        slope = x.T @ (weight * (p - soft)) + 1e-4 * w
        curve = (x.T * (weight * p * (1 - p))) @ x + 1e-4 * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(found: DataFrame) -> np.ndarray:
    """The span classifier's weights from the candidates of all documents."""
    each = found.select(F.explode(F.arrays_zip("kinds", "starts", "ends", "votes")).alias("c"))
    size = F.least(F.length(F.bin((F.col("c.ends") - F.col("c.starts")).cast("long"))), F.lit(7)).alias("size")
    # kinds, votes and size classes are few: at most len(ADDED) * 3 ** len(LABELERS) * 8 rows
    rows = each.select(F.col("c.kinds").alias("kind"), F.col("c.votes").alias("votes"), size).groupBy("kind", "votes", "size").count().orderBy("kind", "votes", "size").collect()
    if not rows:
        return np.zeros(len(ADDED) + 2 * len(LABELERS) + 8)
    kind = np.array([ADDED.index(r["kind"]) for r in rows])
    said = np.array([["-0+".index(v) - 1 for v in r["votes"]] for r in rows])
    n = np.array([r["count"] for r in rows], float)
    soft = reliabilities(said, kind, n)
    return logistic(design(kind, said, np.array([r["size"] for r in rows])), soft, n)


def spans_of(base: str, kinds: list, starts: list, ends: list, said: list, w: np.ndarray) -> list[tuple[int, int, str]]:
    """All spans of a text, by start and kind: the base ones, and the candidates that the classifier accepts. Where accepted
    ones overlap, the first of them (of those that start together, the first kind) stays."""
    out = [(int(a), int(b), k) for k, a, b in (s.split(":") for s in base.split(",") if s)]
    if kinds:
        x = design(np.array([ADDED.index(k) for k in kinds]), np.array([["-0+".index(v) - 1 for v in s] for s in said]), np.array([size_class(b - a) for a, b in zip(starts, ends)]))
        end = 0
        for a, b, k, good in zip(starts, ends, kinds, x @ w > 0):
            if good and a >= end:
                out.append((a, b, k))
                end = b
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


SPANS = ("base", "kinds", "starts", "ends", "votes")


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans (kind:start:end in code points, comma-joined).

    Spans are in order of start, then kind. A null or empty text has none: counts are 0, spans is ''. Rows are
    independent, so repeated rows give repeated results; a null id stays null. An empty table gives an empty one. Other
    columns of docs are left behind, whatever their names.
    """
    found = durable(detected(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), "doc_id", "text"), "candidates")
    w = train(found)  # a few dozen numbers

    @lean
    def run(batches):
        for batch in batches:
            counts, digest, spans = [[] for _ in BASE], [], []
            for row in zip(*(batch.column(c).to_pylist() for c in SPANS)):
                all_ = spans_of(*row, w)
                for out, k in zip(counts, BASE):
                    out.append(sum(s[2] == k for s in all_))
                digest.append(hashlib.sha256(row[0].encode()).hexdigest())
                spans.append(joined(all_))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(digest, pa.string()), pa.array(spans, pa.string())], ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"])

    return found.mapInArrow(run, "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string")


def mask(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with every span found in `text` replaced by its kind in angle brackets; overlapping spans by the first's.

    All columns stay, whatever their names; a null text stays null, an empty one empty. Rows are independent, so repeated
    rows give repeated results; an empty table gives an empty one. The classifier is the one that `find` trains. Spans are
    found once: rows are written with them, and masked when they are read again.
    """
    rest = [c for c in docs.columns if c != text]
    rows = docs.select(F.struct(F.col(f"`{text}`").alias("text"), F.struct(F.lit(0).alias("_"), *(F.col(f"`{c}`") for c in rest)).alias("rest")).alias("row"))
    found = durable(detected(rows, "row", "row.text"), "candidates")
    w = train(found)

    def run(texts: pa.Array, *spans: pa.Array) -> pa.Array:
        out = []
        for t, *row in zip(texts.to_pylist(), *(s.to_pylist() for s in spans)):
            if not t:
                out.append(t)
                continue
            parts, end = [], 0
            for a, b, k in spans_of(*row, w):
                if a >= end:
                    parts += [t[end:a], f"<{k.upper()}>"]
                end = max(end, b)
            out.append("".join([*parts, t[end:]]))
        return pa.array(out, pa.string())

    masked = F.arrow_udf(run, "string")(F.col("row.text"), *SPANS)
    return found.select(*(masked.alias(c) if c == text else F.col("row.rest").getField(c).alias(c) for c in docs.columns))

"""Personal data by weak supervision: labelers vote, EM estimates their reliabilities, and a final span classifier is trained.

1. One scan finds the base spans (fixed patterns) and, in the rest of the text, candidate spans of the same kinds (written-out e-mails,
   IPv6, national phones) and of further ones (secrets, IBANs, social security numbers, addresses, names), and lets regex,
   gazetteer and context labelers vote on every candidate (1 yes, 0 abstain, -1 no).
2. The votes of the whole table are counted by kind and pattern of votes; the counts, at most 3**6 a kind, go to the driver,
   where EM fits each labeler's accuracy and the share of true candidates (a one-coin model per kind).
3. A logistic classifier over shape and context features is fitted to EM's probabilities on ``SAMPLE`` candidates of a kind at most,
   those of the least hash of (doc_id, span), and scores all candidates. Those at ``THRESHOLD`` or more become spans, unless they
   touch a base one. Each kind has its own sample, so a frequent kind takes none of a rare one's places.

Base spans always stay. Texts are scanned whole, in linear time. What is written between the steps holds spans and votes, no
text. Null or empty text and an empty table: no spans. Rows are handled each by itself, repeated ones alike, whatever their id. Of candidates
that overlap, the one of the pattern named first stays, then the leftmost; equal hashes in the sample are ordered by votes.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, insort
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import Tables, slices

KINDS = ("email", "ip", "card", "phone")
EXTRA = ("secret", "iban", "ssn", "address", "name")
ORDER = {k: i for i, k in enumerate(KINDS + EXTRA)}
#: Candidates at most of a kind that its classifier is fitted on, and the probability from which a candidate is a span.
SAMPLE, THRESHOLD = 20_000, 0.9

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile(r"[0-9]")
#: Stands for any digit.
DIGIT = tuple("0123456789")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def _luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    even = sum(int(d) * 2 - 9 * (d > "4") for d in digits[-2::-2])
    return (odd + even) % 10 == 0


def _digits(text: str) -> str:
    return "".join([c for c in text if "0" <= c <= "9"])


def emails(text: str) -> list[tuple[int, int]]:
    """Matches of the email pattern, leftmost and non-overlapping: for each @, the run before it and the host after it."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        before = text[free:at]
        start = free + len(before.rstrip(_LOCAL))
        m = _HOST.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
        free = m.end() if m else at + 1
        at = text.find("@", free)
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("email", s, e) for s, e in emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() <= 37 and 13 <= len(d := _digits(m.group())) <= 19 and _luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m.group())) <= 15:
                out.append(("phone", *m.span()))
    return out


# Candidates: wider patterns. Where one has a group, the group is the span. What must be in a text before its pattern is tried.
_WIDE = (
    ("email", re.compile(r"[A-Za-z0-9._%+-]{1,64} ?[\[(](?:at|AT)[\])] ?[A-Za-z0-9-]{1,64}(?: ?(?:\.|[\[(](?:dot|DOT)[\])]) ?[A-Za-z0-9-]{1,64}){1,4}"), ("[at]", "(at)", "[AT]", "(AT)")),
    ("email", re.compile(r"\b[a-z0-9._%+-]{2,64} at [a-z0-9-]{2,64} dot [a-z]{2,12}\b"), (" dot ",)),
    ("ip", re.compile(r"(?<![0-9A-Za-z:])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![0-9A-Za-z:])"), (":",)),
    ("iban", re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b"), DIGIT),
    ("card", re.compile(r"(?<![0-9])(?:[0-9]{4}[ -]?){3}[0-9]{4}(?![0-9])"), DIGIT),
    ("ssn", re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"), DIGIT),
    ("phone", re.compile(r"(?<![0-9+.-])(?:\([0-9]{3,5}\) ?[0-9]{3,4}[ .-]?[0-9]{3,4}|[0-9]{3}([ .-])[0-9]{3}\1[0-9]{4}|0[0-9]{2,4}[ /-][0-9]{3,4}[ -]?[0-9]{3,4})(?![0-9])"), DIGIT),
    ("secret", re.compile(r"(?i:\b(?:password|passwd|passphrase|pwd|secret|token|api[_-]?key|access[_-]?key))[\"']?\s{0,3}[:=]\s{0,3}[\"']?([^\s\"',;<>]{4,}+)"), (":", "=")),
    ("secret", re.compile(r"[A-Za-z0-9+/_-]{20,}+"), ()),
    ("address", re.compile(r"(?<![0-9])[0-9]{1,5} (?:[A-Z][a-z]{1,20} ){1,3}(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Boulevard|Blvd)\b"), DIGIT),
    ("address", re.compile(r"\b[A-ZÄÖÜ][a-zäöüß]{1,20}(?:stra(?:ß|ss)e|weg|platz|allee) [0-9]{1,4}[a-z]?\b|(?<![0-9])[0-9]{1,4},? (?:rue|boulevard|place) (?:de |du |des |la )?[A-Z][a-zé]{1,20}|\b(?:[Cc]alle|[Aa]venida|[Pp]laza) (?:de )?[A-Z][a-záéíóú]{1,20},? [0-9]{1,4}\b"), DIGIT),
    ("name", re.compile(r"[MDPHFS](?:r|rs|s|rof|err|rau|me|onsieur|adame|eñora?|ra?)\.? ([A-ZÀ-Ý][a-zß-ÿ]{1,20}(?: [A-ZÀ-Ý][a-zß-ÿ]{1,20})?)"), ()),
    ("name", re.compile(r"[A-Z][a-zé]{2,12} [A-Z][a-zß-ÿ]{2,20}"), ()),
)
# Gazetteers, fixed values: words beside personal data, common given names, ends of host names, lengths of IBANs.
GAZETTEER = {
    "email": {"email", "mail", "e-mail", "contact", "write", "courriel", "correo", "kontakt", "reach", "address"},
    "ip": {"ip", "ipv6", "host", "server", "address", "addr", "client", "adresse", "from"},
    "iban": {"iban", "account", "konto", "compte", "cuenta", "bank", "transfer", "bic"},
    "card": {"card", "visa", "mastercard", "amex", "credit", "debit", "carte", "karte", "tarjeta"},
    "ssn": {"ssn", "social", "security", "taxpayer"},
    "phone": {"phone", "tel", "telephone", "call", "mobile", "cell", "fax", "telefon", "llamar", "ring", "teléfono", "téléphone", "anrufen"},
    "secret": {"token", "key", "secret", "password", "passwd", "pwd", "passphrase", "apikey", "api_key", "access_key", "bearer", "credential"},
    "address": {"address", "lives", "live", "street", "adresse", "wohnt", "domicilio", "habite", "ship", "home", "at"},
    "name": {"name", "named", "contact", "signed", "regards", "dear", "patient", "nom", "nombre", "mr", "mrs", "ms", "dr", "herr", "frau", "madame", "señor", "señora"},
}
GIVEN_NAMES = frozenset(
    "James Mary Robert Patricia John Jennifer Michael Linda David Elizabeth William Barbara Richard Susan Joseph Jessica Thomas Sarah Charles Karen Daniel Lisa Matthew Nancy Anthony Betty "
    "Hans Peter Klaus Jürgen Wolfgang Ursula Monika Petra Sabine Stefan Andreas Jean Pierre Michel Alain Marie Nathalie Isabelle Sylvie Philippe Jane Jack Emma Olivia "
    "Antonio José Manuel Francisco Juan Carmen María Josefa Isabel Ana Dolores Pilar Carlos Jorge Luis Laura Anna Paul Mark Julia".split()
)
HOST_ENDS = frozenset("com org net edu gov io de fr es uk it nl ch at eu info example".split())
IBAN_LENGTHS = {"AT": 20, "BE": 16, "CH": 21, "CZ": 24, "DE": 22, "DK": 18, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "IE": 22, "IT": 27, "LU": 20, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "SE": 24}
#: What may stand before and after a secret; nothing at an end of the text.
_OPENS, _CLOSES = ("", *"=: \t\n\r\"'"), ("", *" \t\n\r\"',;.)=")
_WORD = re.compile(r"[^\W\d_][\w-]*")
BEFORE, AFTER = 32, 16
LABELERS = ("shape", "checksum", "gazetteer", "assignment", "variety", "boundary")


def _iban(span: str) -> bool:
    flat = span.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4])) % 97 == 1


def _votes(kind: str, text: str, s: int, e: int) -> tuple[list[int], list[float]]:
    """Votes of LABELERS and the features of one candidate.

    shape and variety look at the span's form, checksum at what its kind prescribes, gazetteer and assignment at the text before
    it, boundary at both sides.
    """
    span, left, right = text[s:e], text[max(0, s - BEFORE) : s], text[e : e + AFTER]
    look = span[:512]
    digits = _digits(look)
    near = {w.lower() for w in _WORD.findall(left)}
    cue = bool(near & GAZETTEER[kind])
    other = any(near & v for k, v in GAZETTEER.items() if k != kind)
    assigned = bool(re.search(r"[=:]\s*[\"']?$", left))
    kinds = sum(bool(re.search(p, look)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    counts = np.unique(list(look), return_counts=True)[1] / len(look)
    entropy = float(-(counts * np.log2(counts)).sum())
    grouped = bool(re.search(r"[0-9][ -][0-9]", look))
    if kind == "card":
        shape, check, variety = (1 if grouped else 0), (1 if _luhn(digits) else -1), (-1 if len(set(digits)) < 4 else 0)
    elif kind == "phone":
        shape, check, variety = (1 if "(" in span or span.count("-") == 2 or span[0] == "0" else 0), (1 if 9 <= len(digits) <= 12 else -1), (-1 if len(set(digits)) < 3 else 0)
    elif kind == "secret":
        shape = 1 if re.fullmatch(r"[0-9a-f]{32,}", look) else -1 if re.fullmatch(r"[A-Z]?[a-z]+|[a-z]+(?:[_/-][a-z]+)+", look) else 0
        check, variety = (1 if digits and re.search("[A-Za-z]", look) else -1), (1 if entropy > 3.3 and kinds > 1 or cue and assigned and kinds > 1 else -1)
    elif kind == "email":
        end = re.findall("[a-z]+", span.lower())[-1:]
        shape, check, variety = (1 if re.search(r"[\[(]", span) else 0), (1 if end and end[0] in HOST_ENDS else -1), 0
    elif kind == "iban":
        flat = span.replace(" ", "")
        shape, check, variety = (1 if IBAN_LENGTHS.get(flat[:2]) == len(flat) else -1), (1 if _iban(span) else -1), (-1 if len(digits) < 8 else 0)
    elif kind == "ssn":
        shape, check, variety = 0, (-1 if digits[:3] in ("000", "666") or digits[0] == "9" or digits[3:5] == "00" or digits[5:] == "0000" else 1), (-1 if len(set(digits)) < 4 else 0)
    elif kind == "address":
        shape, check, variety = 1, (-1 if re.search(r"[.!?] ", span) else 0), (1 if re.match(r",? ?(?:[A-Z][a-z]|[0-9]{4,5})", right) else 0)
    elif kind == "name":
        known = span.split()[0] in GIVEN_NAMES
        shape, check, variety = (1 if " " in span else 0), (1 if known else 0), (1 if re.search(r"(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Monsieur|Madame|Señora?|Sra?)\.? $", left) else 0)
    else:
        shape, check, variety = (1 if span.count(":") == 7 else 0), (1 if re.search("[0-9]", span) else -1), (-1 if entropy < 1.5 else 0)
    votes = [shape, check, 1 if cue else (-1 if other else 0), 1 if assigned and kind in ("secret", "iban", "phone", "email", "ssn") else 0, variety, -1 if right[:1].isalnum() or left[-1:].isalnum() else 0]
    features = [1.0, float(shape), float(check), float(cue), float(other), float(assigned), float(variety), float(votes[5]), entropy / 5, kinds / 4, min(len(span), 256) / 64, len(digits) / len(look), float(grouped), float(left[-1:] in ("", "\n"))]
    return votes, features


def candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Matches of the wide patterns that touch no base span and none of a pattern before."""
    found: list[tuple[str, int, int]] = []
    digit = bool(_DIGIT.search(text))
    for kind, pattern, holds in _WIDE:
        if not digit if holds is DIGIT else holds and not any(x in text for x in holds):
            continue
        for m in pattern.finditer(text):
            start, end = m.span(1) if kind in ("secret", "name") and pattern.groups else m.span()
            if kind == "name" and (not pattern.groups and m.group().split()[0] not in GIVEN_NAMES or text[m.start() - 1 : m.start()].isalnum()):
                continue
            if kind == "secret" and not pattern.groups and not (text[start - 1 : start] in _OPENS and text[end : end + 1] in _CLOSES):
                continue
            found.append((kind, start, end))
    if not found:
        return []
    taken, out = sorted((s, e) for _, s, e in base), []
    for c in found:
        i = bisect_left(taken, (c[1], c[1]))
        if (i == 0 or taken[i - 1][1] <= c[1]) and (i == len(taken) or c[2] <= taken[i][0]):
            out.append(c)
            insort(taken, (c[1], c[2]))
    return out


_FOUND = "doc_id {}, base string, n_email long, n_ip long, n_card long, n_phone long, cands array<struct<kind:string,start:long,end:long,votes:string,x:array<double>>>"


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join([f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (ORDER[x[0]], x[1], x[2]))])


def detect(docs: DataFrame) -> DataFrame:
    """Base spans and voted candidates of each row; no text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("votes", pa.string()), ("x", pa.list_(pa.float64()))]))
        for b in slices(batches):
            bases, counts, found = [], {k: [] for k in KINDS}, []
            for text in b.column("text").to_pylist():
                text = text or ""
                base = base_spans(text)
                bases.append(_joined(base))
                for k in KINDS:
                    counts[k].append(sum(x[0] == k for x in base) if base else 0)
                rows = []
                for k, s, e in candidates(text, base):
                    votes, x = _votes(k, text, s, e)
                    rows.append({"kind": k, "start": s, "end": e, "votes": ",".join(map(str, votes)), "x": x})
                found.append(rows)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(bases, pa.string()), *[pa.array(counts[k], pa.int64()) for k in KINDS], pa.array(found, kind)], ["doc_id", "base", *[f"n_{k}" for k in KINDS], "cands"])

    return docs.select("doc_id", "text").mapInArrow(run, _FOUND.format(docs.schema["doc_id"].dataType.simpleString()))


def em(votes: np.ndarray, counts: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, float]:
    """(probability of each pattern, accuracy of each labeler, share of true ones) of a one-coin model.

    Abstentions say nothing. Accuracies start at 0.8 and are smoothed by ten votes of it, so a labeler that hardly votes keeps it.
    """
    accuracy, share = np.full(votes.shape[1], 0.8), 0.5
    yes, no = votes == 1, votes == -1
    p = np.full(len(votes), 0.5)
    for _ in range(rounds):
        odds = np.log(accuracy / (1 - accuracy))
        p = 1 / (1 + np.exp(-(math.log(share / (1 - share)) + votes @ odds)))
        agree = (counts[:, None] * (yes * p[:, None] + no * (1 - p)[:, None])).sum(0)
        cast = (counts[:, None] * (yes | no)).sum(0)
        accuracy = np.clip((agree + 8) / (cast + 10), 0.55, 0.99)
        share = float(np.clip(((counts * p).sum() + 5) / (counts.sum() + 10), 0.02, 0.98))
    return p, accuracy, share


def logistic(x: np.ndarray, p: np.ndarray, rounds: int = 30, ridge: float = 1e-2) -> np.ndarray:
    """Weights fitted to soft labels by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (q * (1 - q))[:, None]).T @ x / len(x) + ridge * np.eye(x.shape[1])
        w -= np.linalg.solve(h, x.T @ (q - p) / len(x) + ridge * w)
    return w


def _patterns(found: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """kind -> the patterns of votes and how many candidates have each; at most 3**6 a kind."""
    rows = found.select(F.explode("cands").alias("c")).groupBy("c.kind", "c.votes").count().orderBy("kind", "votes").collect()
    kinds = {k: [r for r in rows if r["kind"] == k] for k in sorted({r["kind"] for r in rows})}
    return {k: (np.array([list(map(int, r["votes"].split(","))) for r in own]), np.array([r["count"] for r in own], float)) for k, own in kinds.items()}


def reliabilities(docs: DataFrame) -> dict[str, dict[str, float]]:
    """kind -> each labeler's accuracy as EM estimates it on the candidates of ``docs``, and the ``share`` of true ones."""
    out = {}
    for kind, (votes, counts) in _patterns(detect(docs)).items():
        _, accuracy, share = em(votes, counts)
        out[kind] = {**{n: float(a) for n, a in zip(LABELERS, accuracy, strict=True)}, "share": share}
    return out


def train(found: DataFrame) -> dict[str, list[float]]:
    """kind -> weights, from ``detect``'s rows (written)."""
    sample = found.select("doc_id", F.explode("cands").alias("c")).select("c.kind", "c.votes", "c.x", F.xxhash64("doc_id", "c.kind", "c.start").alias("h"))
    out = {}
    for kind, (votes, counts) in _patterns(found).items():
        p, _, _ = em(votes, counts)
        said = {",".join(map(str, v)): float(x) for v, x in zip(votes.tolist(), p, strict=True)}
        mine = sample.where(F.col("kind") == kind).orderBy("h", "votes").limit(SAMPLE).collect()
        out[kind] = logistic(np.array([r["x"] for r in mine]), np.array([said[r["votes"]] for r in mine])).tolist()
    return out


def _accepts(model: dict[str, list[float]], kind: str, votes: list[int], x: list[float]) -> bool:
    """The classifier's verdict; a failed checksum of a card or an IBAN can't be overruled."""
    if kind not in model or kind in ("card", "iban") and votes[1] < 0:
        return False
    return float(np.dot(model[kind], x)) >= math.log(THRESHOLD / (1 - THRESHOLD))


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of each row of ``docs`` (doc_id, text)."""
    found = Tables(docs.sparkSession, "pii").write(detect(docs))
    model = train(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            hashes, spans = [], []
            for base, cands in zip(b.column("base").to_pylist(), b.column("cands").to_pylist(), strict=True):
                hashes.append(sha256(base.encode()).hexdigest())
                own = [(k, int(s), int(e)) for k, s, e in (x.split(":") for x in base.split(",") if x)]
                own += [(c["kind"], c["start"], c["end"]) for c in cands if _accepts(model, c["kind"], list(map(int, c["votes"].split(","))), c["x"])]
                spans.append(_joined(own))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("doc_id", "n_email", "n_ip", "n_card", "n_phone")], pa.array(hashes, pa.string()), pa.array(spans, pa.string())], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return found.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of its text replaced by its kind in angle brackets; all other columns and rows as they are."""
    tables = Tables(docs.sparkSession, "pii")
    found = tables.write(detect(docs))
    model = train(found)
    tables.drop(found)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out = []
            for text in b.column(at).to_pylist():
                base = base_spans(text or "")
                added = [(k, s, e) for k, s, e in candidates(text or "", base) if _accepts(model, k, *_votes(k, text, s, e))]
                spans = sorted([*base, *added], key=lambda x: (x[1], -x[2]))
                if not spans:
                    out.append(text)
                    continue
                parts, free = [], 0
                for k, s, e in spans:
                    if s >= free:
                        parts += [text[free:s], f"<{k}>"]
                    elif e <= free:
                        continue  # inside the one before
                    free = max(free, e)
                out.append("".join([*parts, text[free:]]))
            yield pa.RecordBatch.from_arrays([*b.columns[:at], pa.array(out, pa.string()), *b.columns[at + 1 :]], b.schema.names)

    # Columns go by their places: names with dots in them are no names to Arrow functions.
    numbered = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return numbered.mapInArrow(run, numbered.schema).toDF(*docs.columns)

"""Personal data by weak supervision.

Base kinds (email, ip, card, phone) follow fixed rules and always stay. Beside
them wider patterns propose candidate spans. Labelers - patterns, gazetteers
and context rules - vote for, against or abstain on every candidate; the votes
are counted by pattern over all documents, expectation-maximisation estimates
each labeler's reliability from those counts, and a logistic span classifier is
trained on the resulting posteriors. It reads shape features besides the votes
and decides which candidates are added.

One scan of the texts stores the candidates; everything after works on that
small table. What reaches the driver is one row a vote pattern, whose number
is bounded by the patterns that exist (kinds x votes x shapes), not by the corpus.

Edge cases: null and empty texts have no spans; repeated rows give repeated
results; an empty table gives an empty result; extra columns are not carried.
Spans are in code points, end exclusive. Added spans never overlap base spans
or one another (the earlier, then a true IBAN, then the longer stays). Every pattern
is linear in a text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import renamed, stored

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("secret", "iban", "national_id", "local_phone", "person", "address")
KINDS = BASE_KINDS + ADDED_KINDS

# Fixed patterns of the base kinds. An address is found by its at sign first.
AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
#: Runs of digits are taken whole: a match cannot start inside one nor give digits back.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: What may be personal beyond the base kinds, one named pattern a kind. All are
#: linear in the text: repeats are bounded, or runs that start at a separator.
SECRET = re.compile(r"\bAKIA[0-9A-Z]{16}\b|(?<=[=:\x20\"'])[A-Za-z0-9+/_-]{16,}+")
WIDER = re.compile(
    r"(?P<iban>\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?\b)"
    r"|(?P<national_id>(?<![\w.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-]))"
    r"|(?P<local_phone>(?<![\w.+-])(?:\([0-9]{2,5}\)\x20?|[0-9]{2,5}[\x20.-])[0-9]{2,4}(?:[\x20.-][0-9]{2,4}){1,3}(?![\w-]))"
    r"|(?P<person>\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Monsieur|Madame|Señor|Señora|Sra)\b\.?\x20[A-Z][\w'’-]{1,40}(?:\x20[A-Z][\w'’-]{1,40})?)"
    r"|(?P<address>\b[0-9]{1,5}\x20(?:[A-Z][a-z]{1,30}\x20){1,3}(?:Street|St|Avenue|Ave|Road|Rd|Lane|Drive|Boulevard|Blvd)\b\.?)"
)
#: A text without any of these has no candidate; saves most of the scan.
HINT = re.compile(r"[0-9]|\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Monsieur|Madame|Señor|Señora|Sra)\b")

# Gazetteers of the context labelers.
SECRET_WORDS = ("password", "passwd", "pwd", "token", "secret", "key", "apikey", "credential", "auth", "passwort", "contraseña")
CONTACT_WORDS = ("phone", "tel", "mobile", "call", "fax", "contact", "telefon", "téléphone", "teléfono", "whatsapp")
IDENTITY_WORDS = ("ssn", "sozialversicherung", "sécurité sociale", "seguridad social", "dni", "born", "lives", "signed", "patient", "customer", "employee", "iban", "account", "konto", "compte", "cuenta", "social security", "passport", "name", "address", "adresse", "dirección")
NUMBER_WORDS = ("version", "v", "isbn", "issn", "ean", "sku", "invoice", "serial", "build", "score", "pages", "seite", "página", "no", "nr", "vol", "page", "figure", "fig", "table", "section", "chapter", "price", "usd", "eur", "total", "order", "item", "doi", "rfc")
# Frequent given names of the four languages (common knowledge, lower case).
GIVEN_NAMES = frozenset(
    "james john robert michael william david richard joseph thomas charles christopher daniel matthew anthony mark steven paul andrew joshua kevin brian george edward "
    "mary patricia jennifer linda elizabeth barbara susan jessica sarah karen lisa nancy margaret sandra ashley emily emma olivia anna laura amy rachel helen ruth alice grace "
    "jean pierre michel andré philippe jacques louis françois nicolas julien antoine luc marc hugo gabriel "
    "marie nathalie isabelle sylvie catherine françoise sophie camille chloé léa manon julie claire hélène "
    "hans peter klaus wolfgang jürgen stefan andreas uwe karl heinz lukas felix jonas leon max "
    "claudia sabine petra monika ursula katharina lena hannah mia johanna greta "
    "josé antonio juan manuel francisco luis javier carlos miguel pedro jesús alejandro pablo sergio diego "
    "maría carmen ana isabel dolores pilar teresa rosa cristina marta elena lucía paula sofía".split()
)
_AGAINST = re.compile(rf"\b(?:{'|'.join(NUMBER_WORDS)})\b\W*\Z")
ANCHOR = 0.98
LABELERS = ("shape", "context", "against", "checksum", "mixture", "gazetteer")
_CONTEXT = {
    "secret": SECRET_WORDS,
    "iban": IDENTITY_WORDS,
    "national_id": IDENTITY_WORDS,
    "local_phone": CONTACT_WORDS,
    "person": IDENTITY_WORDS + CONTACT_WORDS,
    "address": IDENTITY_WORDS + CONTACT_WORDS,
    "email": CONTACT_WORDS,
    "ip": ("ip", "host", "address", "server"),
    "card": ("card", "visa", "credit", "payment"),
    "phone": CONTACT_WORDS,
}


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _local_start(text: str, least: int, at: int) -> int:
    """Where the run of local-part characters before ``at`` begins, ``least`` at the earliest."""
    width = 64
    while True:
        lo = max(least, at - width)
        run = LOCAL.match(text[lo:at][::-1])
        length = run.end() if run else 0
        if length < at - lo or lo == least:
            return at - length
        width *= 8


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) of the base kinds, by kind, then start."""
    out = []
    done = 0
    if "@" in text:
        for m in AT.finditer(text):
            begin = _local_start(text, done, m.start())
            if begin < m.start():
                done = m.end()
                out.append((0, begin, done))
    out += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(len(p) <= 3 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in m[0].split(".")))]
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def _iban_ok(value: str) -> bool:
    compact = value.replace(" ", "")
    turned = compact[4:] + compact[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def votes(kind: str, text: str, start: int, end: int) -> str:
    """One sign a labeler: ``+`` for, ``-`` against, ``.`` abstains."""
    value, before = text[start:end], text[max(0, start - 40) : start].lower()
    digits = sum(c.isdigit() for c in value)
    letters = sum(c.isalpha() for c in value)
    shape = {
        "secret": value.startswith("AKIA") or (digits >= 4 and letters >= 3 and len(set(value)) >= 9),
        "iban": 15 <= len(value.replace(" ", "")) <= 34,
        "national_id": value[:3] not in ("000", "666") and value[0] != "9",
        "local_phone": 9 <= digits <= 12 and not re.fullmatch(r"[0-9]{1,3}(?:[\x20.][0-9]{3})+", value),
    }.get(kind, True)
    near = any(w in before for w in _CONTEXT[kind])
    against = _AGAINST.search(before) is not None
    check = "."
    if kind == "iban":
        check = "+" if _iban_ok(value) else "-"
    elif kind == "card":
        check = "+"
    elif kind == "secret":
        kinds = sum((any(c.islower() for c in value), any(c.isupper() for c in value), digits > 0))
        check = "+" if len(set(value)) >= 9 and (kinds >= 2) else "-"
    mixture = "."
    if kind in ("secret", "iban"):
        if value.startswith("AKIA") or digits and letters and len(set(value)) >= 9 and re.search(r"[=:\"']\s*\Z", before):
            mixture = "+"
        elif sum(len(part) >= 3 and part.isalpha() for part in re.split(r"[-_/]", value)) >= 2:  # joined words
            mixture = "-"
    elif kind in ("local_phone", "national_id"):
        mixture = "-" if re.search(r"[#$€£]\s*\Z", before) or re.fullmatch(r"(?:19|20)[0-9]{2}[.-][0-9]{2}[.-][0-9]{2}", value) else "."
    gazetteer = "."
    if kind == "person":
        gazetteer = "+" if any(w.lower() in GIVEN_NAMES for w in value.split()[1:]) else "."
    elif kind == "secret":
        gazetteer = "+" if near and re.search(r"[=:]\s*[\"']?\Z", before) else "."
    return "".join(("+" if shape else "-", "+" if near else ".", "-" if against else ".", check, mixture, gazetteer))


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, str]]:
    """(kind number, start, end, pattern); base spans take part as kinds of their own.

    A pattern is ``kind|votes|length class``.
    """
    out = [(k, a, b, f"{KINDS[k]}|{votes(KINDS[k], text, a, b)}|{min(9, (b - a) // 4)}") for k, a, b in base]
    if not HINT.search(text):
        return out
    taken = sorted((a, b) for _, a, b in base)
    at = end = 0
    for a, b, kind in wider_spans(text):
        while at < len(taken) and taken[at][1] <= a:
            at += 1
        if a < end or at < len(taken) and taken[at][0] < b:
            continue
        end = b
        out.append((KINDS.index(kind), a, b, f"{kind}|{votes(kind, text, a, b)}|{min(9, (b - a) // 4)}"))
    return out


def wider_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of what the wider patterns propose; of two at one place a true IBAN, then the longer, comes first."""
    out = [(m.start(), m.end(), m.lastgroup) for m in WIDER.finditer(text)]
    for m in SECRET.finditer(text):
        value = m[0]
        if any(c.isdigit() for c in value) and any(c.isalpha() for c in value):
            out.append((m.start(), m.end(), "secret"))
    return sorted(out, key=lambda x: (x[0], not (x[2] == "iban" and _iban_ok(text[x[0] : x[1]])), -x[1], x[2]))


_SPAN = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("pattern", pa.string())])


def scan(df: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The columns in ``keep`` and spans array<struct<kind, start, end, pattern>>."""

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for value in batch.column(len(keep)):
                body = value.as_py() or ""
                found.append([dict(zip(("kind", "start", "end", "pattern"), c, strict=True)) for c in candidates(body, base_spans(body))])
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(found, pa.list_(_SPAN))], names=[*keep, "spans"])

    spans = StructType.fromDDL("spans array<struct<kind:int,start:int,end:int,pattern:string>>")
    schema = StructType(df.select(*keep).schema.fields + spans.fields)
    return df.select(*keep, F.col(text).alias("_body")).mapInArrow(scanned, schema)


def reliabilities(patterns: list[tuple[str, int]], rounds: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expectation-maximisation over vote patterns, labelers independent given the class.

    Base kinds anchor the positive class: their rules hold by definition, so
    their posterior stays. Returns the posterior of each pattern, and each
    labeler's chance of voting (for, against, abstaining) in the two classes.
    """
    marks = np.array([["+-.".index(v) for v in p.split("|")[1]] for p, _ in patterns])
    count = np.array([n for _, n in patterns], float)
    sure = np.array([p.split("|")[0] in BASE_KINDS for p, _ in patterns])
    post = np.clip(0.5 + 0.2 * ((marks == 0).sum(1) - 1.5 * (marks == 1).sum(1)), 0.05, 0.95)
    post[sure] = ANCHOR
    # A very common pattern counts by its root: kinds that are frequent must
    # not decide alone how far a labeler is trusted.
    count = np.sqrt(count)
    chance = np.full((2, marks.shape[1], 3), 1 / 3)
    for _ in range(rounds):
        for c, share in enumerate((1 - post, post)):
            for j in range(marks.shape[1]):
                chance[c, j] = np.bincount(marks[:, j], share * count, 3) + 1
            chance[c] /= chance[c].sum(1, keepdims=True)
        prior = np.clip((post * count).sum() / count.sum(), 0.05, 0.95)
        pull = np.log(chance[1] / chance[0])
        # A labeler is taken to be better than chance: a vote for never counts
        # against, nor the reverse; an abstention says nothing.
        pull = np.stack((np.maximum(pull[:, 0], 0), np.minimum(pull[:, 1], 0), np.zeros(len(pull))), axis=1)
        score = np.log(prior / (1 - prior)) + pull[np.arange(len(pull)), marks].sum(1)
        new = np.where(sure, ANCHOR, 1 / (1 + np.exp(-np.clip(score, -30, 30))))
        done, post = np.abs(new - post).max() < 1e-6, new
        if done:
            break
    return post, chance, marks


def _features(pattern: str) -> list[float]:
    kind, marks, size = pattern.split("|")
    return [1.0, *(float(v == s) for v in marks for s in "+-"), *(float(kind == k) for k in KINDS), int(size) / 9]


def span_classifier(patterns: list[tuple[str, int]], steps: int = 400, ridge: float = 0.02) -> dict[str, float]:
    """Chance that a span is personal, by pattern: logistic regression on EM's posteriors."""
    if not patterns:
        return {}
    post, _, _ = reliabilities(patterns)
    x = np.array([_features(p) for p, _ in patterns])
    weight = np.sqrt([n for _, n in patterns])
    weight /= weight.sum()
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-x @ w))
        grad = x.T @ (weight * (p - post)) + ridge * 0.01 * w
        bend = (x * (weight * p * (1 - p))[:, None]).T @ x + (ridge * 0.01 + 1e-9) * np.eye(len(w))
        step = np.linalg.solve(bend, grad)
        w -= step / max(1.0, np.abs(step).max())
        if np.abs(step).max() < 1e-8:
            break
    return dict(zip((p for p, _ in patterns), (1 / (1 + np.exp(-x @ w))).tolist(), strict=True))


def accepted_patterns(scanned: DataFrame, threshold: float = 0.5) -> list[str]:
    """Patterns of added kinds that the trained classifier accepts."""
    counted = scanned.select(F.explode("spans.pattern").alias("pattern")).groupBy("pattern").count()
    patterns = sorted((r["pattern"], r["count"]) for r in counted.collect())
    chance = span_classifier(patterns)
    return [p for p, c in chance.items() if c >= threshold and p.split("|")[0] in ADDED_KINDS]


def chosen_spans(accepted: list[str]) -> Column:
    """Base and accepted spans of a scanned row, by kind, then start."""
    chosen = F.filter("spans", lambda s: (s["kind"] < len(BASE_KINDS)) | (s["pattern"].isin(accepted) if accepted else F.lit(False)))
    return F.array_sort(F.transform(chosen, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _of_kind(number: int) -> Column:
    return F.filter("_s", lambda s: s["kind"] == number)


def find_pii(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, n_email, n_ip, n_card, n_phone, base_sha256, spans string, n_spans of every row."""
    scanned = stored(scan(df, (key,), text), "pii-spans")
    found = scanned.select(key, chosen_spans(accepted_patterns(scanned)).alias("_s"))
    count = [F.size(_of_kind(i)).cast("long").alias(f"n_{k}") for i, k in enumerate(BASE_KINDS)]
    base = F.filter("_s", lambda s: s["kind"] < len(BASE_KINDS))
    return found.select(key, *count, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("_s")).alias("spans"), F.size("_s").cast("long").alias("n_spans"))


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with every span of ``text`` replaced by ``<kind>``; other columns as they are.

    One scan of the texts, stored with what it found; a second pass over that
    table only cuts the accepted spans out.
    """
    plain, names = renamed(df)
    scanned = stored(scan(plain, tuple(plain.columns), names[text]), "pii-spans")
    spans = F.array_sort(F.transform(chosen_spans(accepted_patterns(scanned)), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    at, order = df.columns.index(text), list(plain.columns)
    ready = scanned.select(*plain.columns, spans.alias("_found"))

    def clean(body: str, spans: list[dict]) -> str:
        out, done = [], 0
        for s in spans:
            if s["start"] >= done:
                out += [body[done : s["start"]], f"<{KINDS[s['kind']]}>"]
            done = max(done, s["end"])
        return "".join([*out, body[done:]])

    def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *columns, found = batch.columns
            rows = np.flatnonzero(np.asarray(pc.list_value_length(found).fill_null(0)) > 0)
            if len(rows):
                mask = np.zeros(batch.num_rows, bool)
                mask[rows] = True
                new = [clean(columns[at][i].as_py(), found[i].as_py()) for i in rows.tolist()]
                columns[at] = pc.replace_with_mask(columns[at], pa.array(mask), pa.array(new, columns[at].type))
            yield pa.RecordBatch.from_arrays(columns, names=order)

    out = ready.mapInArrow(cleaned, plain.schema)
    return out.select(*[F.col(new).alias(old) for old, new in names.items()])

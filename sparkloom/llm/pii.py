"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import with_columns

#: In this order spans are listed. The first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
SPANS = "array<struct<kind:string,start:int,end:int,base:boolean,score:double>>"

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A run of digits that fails from its first digit fails from the others as well: the look-behind skips them.
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")

#: Words that speak for a kind when they stand near it, in English, German, French and Spanish.
CONTEXT = {
    "email": ("mail", "e-mail", "email", "contact", "write", "kontakt", "schreiben", "courriel", "écrire", "correo", "contacto", "escribir"),
    "ip": ("ip", "address", "server", "host", "adresse", "rechner", "serveur", "dirección", "servidor"),
    "card": ("card", "credit", "visa", "mastercard", "payment", "karte", "kreditkarte", "zahlung", "carte", "crédit", "paiement", "tarjeta", "crédito", "pago"),
    "phone": ("phone", "call", "tel", "telephone", "mobile", "fax", "telefon", "anruf", "handy", "téléphone", "appeler", "portable", "teléfono", "llamar", "móvil"),
    "iban": ("iban", "account", "bank", "bic", "konto", "compte", "banque", "cuenta", "banco"),
    "ssn": ("ssn", "social", "security", "sozialversicherung", "sécurité", "sociale", "seguridad"),
}
#: Score before context, what one context word adds, and how many characters on either side count as near.
PRIOR = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.7, "iban": 0.9, "ssn": 0.3}
GAIN, NEAR, KEEP = 0.3, 40, 0.5


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """ISO 7064: the first four characters go to the end, letters count from A = 10."""
    turned = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """A match is the whole run of local characters before an @, so it is read off each @ in turn."""
    last = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            last = m.end()
        at = text.find("@", max(at + 1, last))


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.groups()):
            yield m.span()


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    for m in PHONE.finditer(text):
        if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
            yield m.span()


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    for m in IBAN.finditer(text):
        parts, end = m[0], m.end()
        # Words in capitals may follow the number: the longest piece that passes the check is taken.
        while len(bare := parts.replace(" ", "")) >= 15:
            if mod97(bare):
                yield m.start(), end
                break
            cut = parts.rstrip(" ")
            cut = cut[: cut.rfind(" ")] if " " in cut else ""
            end, parts = m.start() + len(cut), cut


def _ssns(text: str) -> Iterator[tuple[int, int]]:
    for m in SSN.finditer(text):
        yield m.span()


FINDERS = {"email": _emails, "ip": _ips, "card": _cards, "phone": _phones, "iban": _ibans, "ssn": _ssns}


def _score(kind: str, text: str, start: int, end: int) -> float:
    near = re.findall(r"[^\W\d_][\w-]*", (text[max(0, start - NEAR) : start] + " " + text[end : end + NEAR]).lower())
    return round(min(1.0, PRIOR[kind] + GAIN * sum(w in CONTEXT[kind] for w in set(near))), 3)


def spans_of(text: str | None, keep: float = KEEP) -> list[tuple[str, int, int, bool, float]]:
    """All spans of one text, by kind, then start. Base kinds stay at any score, others from ``keep`` on."""
    out = []
    for kind in KINDS if text else ():
        base = kind in KINDS[:4]
        for start, end in FINDERS[kind](text):
            score = _score(kind, text, start, end)
            if base or score >= keep:
                out.append((kind, start, end, base, score))
    return out


def find_pii(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with ``pii``: the spans (kind, start, end, base, score) of personal data in the whole text.

    start and end count code points, end exclusive. Texts without a digit or @ hold none and don't leave the JVM.
    Null and empty texts have no spans. A very long text is scanned in time proportional to its length. Repeated rows
    get equal spans. Empty table: empty result. An input column named pii is replaced.
    """

    @F.pandas_udf(SPANS)
    def spans(texts: pd.Series) -> pd.Series:
        return texts.map(spans_of)

    empty = F.array().cast(SPANS)
    asked = F.col(text_col).rlike("[0-9@]")
    found = spans.asNondeterministic()(F.when(asked, F.col(text_col)))
    return with_columns(docs.withColumn("__found", found), {"pii": F.coalesce("__found", empty)}).drop("__found")


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with each span of personal data replaced by its kind in angle brackets; overlapping spans give one mark, of the span that starts first."""

    @F.pandas_udf("string")
    def masked(texts: pd.Series) -> pd.Series:
        def one(text):
            out, last = [], 0
            for kind, start, end, _, _ in sorted(spans_of(text), key=lambda s: (s[1], -s[2])):
                if start >= last:
                    out += [text[last:start], f"<{kind}>"]
                last = max(last, end)
            return None if text is None else "".join(out) + text[last:]

        return texts.map(one)

    hot = F.col(text_col).rlike("[0-9@]")
    return docs.withColumn("__masked", masked(F.when(hot, F.col(text_col)))).withColumn(text_col, F.when(hot, F.col("__masked")).otherwise(F.col(text_col))).drop("__masked")


def digest(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: (s["kind"] == kind) & s["base"])).cast("long")

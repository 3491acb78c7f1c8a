"""Op 10: personal data by patterns, checksums and nearby context, in DataFrame functions only.

For each kind a regular expression proposes spans: the text is copied with a mark
on either side of every match and split at the marks, so that the lengths of the
pieces give the matches' places in code points.  Checks then confirm: number
ranges of IP parts, digit counts, Luhn for cards, mod 97 for IBANs, mod 11 for Dutch citizen numbers.  A score
starts at the kind's prior and gains where one of the kind's context words stands within ``reach`` characters
of the span, before or behind, and loses where a word such as "example" does; spans under ``least`` go.  Of the kinds beyond the base
ones (email, ip, card, phone, which always stay) all but a MAC address and an IBAN of its country's length need
their context to be kept, and any of them goes next to "example".

The patterns are written for texts of any length: no nested repetition (Java's
matcher recurses there), and no second scan of a run that already failed.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgrid.llm.shared import table

#: Marks that stand for a match's ends, a separator between digits, and a dot between host labels.
_OPEN, _CLOSE, _JOIN, _DOT = "\x01", "\x02", "\x03", "\x04"
_LOCAL = rf"A-Za-z0-9._%+{_DOT}-"
#: Pieces whose ends are summed at a time.
_RUN = 256
#: A match begins where no character of its first class stands before it, or where the last match ended.
_EMAIL = rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++{_DOT}[A-Za-z0-9{_DOT}-]++"
_IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = rf"[0-9][0-9{_JOIN}]++"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
_SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
_MAC = r"(?<![0-9A-Za-z:-])(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}(?![0-9A-Za-z:-])"
_BSN = r"(?<![0-9A-Za-z.-])[0-9]{9}(?![0-9A-Za-z-])"
_SECRET = r"(?<![0-9A-Za-z_/+-])[0-9A-Za-z_-]{20,}+(?![/+])"
_BASE = ("email", "ip", "card", "phone")


class Kind(NamedTuple):
    name: str
    prior: float
    context: tuple[str, ...]


#: Order of the kinds in a list of spans.
KINDS = (
    Kind("email", 0.9, ("mail", "contact")),
    Kind("ip", 0.9, ("ip", "address", "host")),
    Kind("card", 0.9, ("card", "visa", "credit")),
    Kind("phone", 0.9, ("phone", "tel", "call")),
    Kind("iban", 0.3, ("iban", "account", "bank", "sepa")),
    Kind("ssn", 0.2, ("ssn", "social", "security")),
    Kind("mac", 0.6, ("mac", "device", "hardware", "ethernet", "wifi")),
    Kind("bsn", 0.2, ("bsn", "sofi", "burgerservice")),
    Kind("secret", 0.3, ("token", "secret", "passw", "key", "bearer", "credential", "auth")),
)
_GAIN, _LOSS, _COUNTRY = 0.4, 0.3, 0.3
_UNLIKELY = ("example", "sample", "dummy", "placeholder", "isbn", "version", "serial")
#: Lengths of an IBAN by country.
_IBAN_LENGTH = {
    "AD": 24, "AE": 23, "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27,
    "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IS": 26, "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25,
    "RO": 24, "SA": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TR": 26,
}


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _luhn(s: Column) -> Column:
    """16 to 19 digits whose Luhn sum ends in 0."""
    reverse = F.reverse(_digits(s))
    digits = F.filter(F.split(reverse, ""), lambda c: c != "")
    doubled = F.transform(digits, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") * 2 / 10).cast("int")))
    return F.length(reverse).between(16, 19) & (F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0)


def _mod97(s: Column) -> Column:
    """An IBAN of 15 to 34 characters whose rearranged number leaves 1 modulo 97."""
    plain = F.replace(s, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4))
    chars = F.filter(F.split(turned, ""), lambda c: c != "")
    value = lambda c: F.when(c.between("0", "9"), c.cast("int")).otherwise(F.ascii(c) - 55)
    rest = F.aggregate(chars, F.lit(0), lambda a, c: (a * F.when(c.between("0", "9"), 10).otherwise(100) + value(c)) % 97)
    return F.length(plain).between(15, 34) & (rest == 1)


def _mod11(s: Column) -> Column:
    """Nine digits, weighted 9 to 2 and -1, whose sum is a multiple of 11; not all zero."""
    total = sum((F.substring(s, i + 1, 1).cast("int") * w for i, w in enumerate((9, 8, 7, 6, 5, 4, 3, 2, -1))), F.lit(0))
    return (total % 11 == 0) & (s != "000000000")


def _small_parts(s: Column) -> Column:
    """Four parts of at most 255, leading zeros allowed."""
    parts = F.transform(F.split(s, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
    return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.substring(p, 1, 3).cast("int") <= 255))


_CHECKS = {
    "email": lambda s: F.lit(True),
    "ip": _small_parts,
    "card": _luhn,
    "phone": lambda s: F.length(_digits(s)).between(8, 15),
    "iban": _mod97,
    "ssn": lambda s: ~s.rlike("^(000|666|9..)|-00-|-0000$"),
    "mac": lambda s: ~s.rlike("^(00[:-]){5}00$|^([Ff]{2}[:-]){5}[Ff]{2}$"),
    "bsn": lambda s: _mod11(s),
    "secret": lambda s: s.rlike("[0-9]") & s.rlike("[A-Za-z]") & ~s.rlike("^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-"),
}


def _cut(text: Column, pattern: str) -> Column:
    """The text's pieces: not matched, matched, not matched, ..."""
    return F.split(F.regexp_replace(text, f"({pattern})", f"{_OPEN}$1{_CLOSE}"), f"[{_OPEN}{_CLOSE}]", -1)


def _matches(pieces: Column, reach: int) -> Column:
    """Every second piece with its place and surroundings: array of struct(start, end, part, near).

    Ends of pieces are summed in runs of ``_RUN``, so that no long array is copied for every match.
    """
    none = F.array().cast("array<int>")

    def ends(runs: Column, n: Column) -> Column:
        last = F.get(runs, F.size(runs) - 1)
        start = F.struct(F.coalesce(F.get(last, F.size(last) - 1), F.lit(0)).alias("at"), none.alias("ends"))
        add = lambda s, piece: F.struct((s["at"] + F.length(piece)).alias("at"), F.concat(s["ends"], F.array(s["at"] + F.length(piece))).alias("ends"))
        return F.concat(runs, F.array(F.aggregate(F.slice(pieces, n * _RUN + 1, F.lit(_RUN)), start, add, lambda s: s["ends"])))

    all_ends = F.flatten(F.aggregate(F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / _RUN).cast("int")), F.array().cast("array<array<int>>"), ends))

    def spans(x: Column) -> Column:
        piece = lambda i: F.coalesce(F.get(x["pieces"], i), F.lit(""))

        def one(i: Column) -> Column:
            before = F.right(F.concat(F.right(piece(i - 3), F.lit(reach)), piece(i - 2), piece(i - 1)), F.lit(reach))
            near = F.lower(F.concat(before, F.lit(" "), F.left(piece(i + 1), F.lit(reach))))
            return F.struct(F.get(x["ends"], i - 1).alias("start"), F.get(x["ends"], i).alias("end"), piece(i).alias("part"), near.alias("near"))

        return F.transform(F.sequence(F.lit(1), F.size(x["pieces"]) - 2, F.lit(2)), one)

    # a list of one, so that the ends are worked out once and not for every match
    return F.get(F.transform(F.array(F.struct(pieces.alias("pieces"), all_ends.alias("ends"))), spans), F.lit(0))


def _proposals(clean: Column) -> dict[str, Column]:
    """Pieces by kind; a kind whose needed characters are absent is one piece, without a scan."""
    dotted = F.regexp_replace(clean, r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", _DOT)
    joined = F.regexp_replace(clean, "(?<=[0-9])[ -](?=[0-9])", _JOIN)
    whole = F.array(clean)
    has = lambda *s: [clean.contains(x) for x in s]
    return {
        "email": F.when(has("@")[0], _cut(dotted, _EMAIL)).otherwise(whole),
        "ip": F.when(clean.rlike(r"[0-9]\.[0-9]"), _cut(clean, _IP)).otherwise(whole),
        "card": F.when(clean.rlike("[0-9][0-9 -][0-9]"), _cut(joined, _CARD)).otherwise(whole),
        "phone": F.when(has("+")[0], _cut(clean, _PHONE)).otherwise(whole),
        "iban": F.when(clean.rlike("[A-Z]{2}[0-9]{2}"), _cut(clean, _IBAN)).otherwise(whole),
        "ssn": F.when(clean.rlike("[0-9]-[0-9]{2}-[0-9]"), _cut(clean, _SSN)).otherwise(whole),
        "mac": F.when(clean.rlike("[0-9A-Fa-f]{2}[:-][0-9A-Fa-f]{2}[:-]"), _cut(clean, _MAC)).otherwise(whole),
        "bsn": F.when(clean.rlike("[0-9]{9}"), _cut(clean, _BSN)).otherwise(whole),
        "secret": F.when(clean.rlike("[0-9A-Za-z_-]{20}"), _cut(clean, _SECRET)).otherwise(whole),
    }


def find_pii(docs: DataFrame, least: float = 0.5, reach: int = 40) -> DataFrame:
    """All columns of ``docs`` and ``pii``: array of struct(kind, start, end, score), by kind, then start; scores have two digits.

    ``docs`` needs text; an older column ``pii`` is replaced.  start and end count code points, end exclusive.
    Within a kind spans never overlap; spans of different kinds may.  A null text counts as empty.  Control
    characters U+0001 to U+0004 in a text count as ordinary characters.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    clean = F.when(text.rlike(f"[{_OPEN}-{_DOT}]"), F.regexp_replace(text, f"[{_OPEN}-{_DOT}]", "�")).otherwise(text)
    held = docs.withColumn("__clean", clean)
    pieces = held.select("*", F.struct(*[c.alias(k) for k, c in _proposals(F.col("__clean")).items()]).alias("__pieces"))

    def spans(kind: Kind) -> Column:
        found = F.filter(_matches(F.col("__pieces")[kind.name], reach), lambda m: _CHECKS[kind.name](m["part"]))

        def scored(m: Column) -> Column:
            stands = lambda words: m["near"].rlike("(^|[^a-z])(" + "|".join(words) + ")")
            score = F.lit(kind.prior) + F.when(stands(kind.context), _GAIN).otherwise(0.0) - F.when(stands(_UNLIKELY), _LOSS).otherwise(0.0)
            if kind.name == "iban":
                plain = F.replace(m["part"], F.lit(" "), F.lit(""))
                score = score + F.when(F.concat(F.substring(plain, 1, 2), F.length(plain)).isin([f"{c}{n}" for c, n in _IBAN_LENGTH.items()]), _COUNTRY).otherwise(0.0)
            score = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 2)
            return F.struct(F.lit(kind.name).alias("kind"), m["start"].cast("long").alias("start"), m["end"].cast("long").alias("end"), score.alias("score"))

        spans_ = F.when(F.size(F.col("__pieces")[kind.name]) > 1, F.transform(found, scored)).otherwise(F.array().cast("array<struct<kind:string,start:long,end:long,score:double>>"))
        return spans_ if kind.name in _BASE else F.filter(spans_, lambda s: s["score"] >= least)

    return pieces.withColumn("pii", F.concat(*[spans(k) for k in KINDS])).drop("__clean", "__pieces")


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` of ``find_pii`` with every span's text replaced by its kind in brackets, without ``pii``.

    Where spans overlap, the one that starts first (then the longer, then the first kind) stands for what it covers;
    a later one hides only what is left of it behind that, without a mark of its own.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    order = lambda a, b: F.when(a["start"] != b["start"], F.when(a["start"] < b["start"], -1).otherwise(1)).when(a["end"] != b["end"], F.when(a["end"] > b["end"], -1).otherwise(1)).otherwise(0)
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(state: Column, s: Column) -> Column:
        gap = F.when(s["start"] >= state["at"], F.concat(F.substr(text, (state["at"] + 1).cast("int"), (s["start"] - state["at"]).cast("int")), F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise(F.lit(""))
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.concat(state["out"], gap).alias("out"))

    done = F.aggregate(F.array_sort("pii", order), start, step, lambda s: F.concat(s["out"], F.substr(text, (s["at"] + 1).cast("int"), F.length(text))))
    return docs.withColumn("text", F.when(F.size("pii") > 0, done).otherwise(F.col("text"))).drop("pii")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _count(kind: str) -> Column:
    return F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    base = F.filter("pii", lambda s: s["kind"].isin(*_BASE))
    counts = [_count(k).alias(f"n_{k}") for k in _BASE]
    return found.select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("pii")).alias("spans"), F.array_join(F.transform("pii", lambda s: s["score"].cast("string")), ",").alias("scores"))

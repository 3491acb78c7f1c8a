"""Op 5: URL filtering with host and path rules and a weighted vocabulary.

Rules come first: the longest one that fits decides.  For all other URLs one
Aho-Corasick automaton over the vocabulary scans the lower-cased URL once.  A term counts where no letter or digit
touches it.  One strict term blocks, whatever it overlaps.  Of soft terms that overlap only the leftmost, then longest counts, so
that one place counts once; two or more different ones block if their weights reach ``soft_limit``: two of the weighty kind or
one and a mild one, but three of the mild kind.  A soft term alone never does.

The vocabulary is data: a DataFrame of term, kind (strict or soft) and weight, of at most ``MAX_TERMS`` rows, which
travels with the tasks.  ``DEFAULT_TERMS`` is only where to start from.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgrid.llm.shared import table

#: (term, kind, weight): common words of adult, gambling, pharmacy, piracy and spam sites.
DEFAULT_TERMS = (
    *((t, "strict", 0) for t in "adult-x casino-win cheap-pills hardcore hentai milf porn pornhub pornstar sexcam spam-farm viagra xvideos xxx".split()),
    *((t, "soft", 2) for t in "ads-track adult casino cialis escort free-bets gambling jackpot keygen nude nudes online-pharmacy poker sex sexy torrent warez webcam".split()),
    *((t, "soft", 1) for t in "ads bet bets betting bonus cheap click coupon crack dating deal download free girls hot loan loans lottery pharmacy pills prize promo rx slots spam spin stream track win winner".split()),
)
SOFT_LIMIT = 3
#: Different soft terms that it takes to block.
SOFT_TERMS = 2
MAX_TERMS = 1_000_000
#: (host, path, verdict)
RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ALNUM = frozenset(_LOWER + "0123456789")
_SCHEMA = pa.schema([("page_id", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("verdict", pa.string()), ("strict_hits", pa.int64()), ("soft_hits", pa.int64()), ("soft_weight", pa.int64())])


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    host = F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def longest_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, null where none does."""
    rule = verdict = F.lit(None).cast("string")
    for of, start, what in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == of) | host.endswith("." + of)) & path.startswith(start)
        rule, verdict = F.when(fits, of + start).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def _automaton(terms: Sequence[str]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for t in terms:
        found.add_word(t, t)
    found.make_automaton()
    return found


def _hits(find: ahocorasick.Automaton, text: str, strict: frozenset[str]) -> set[str]:
    """Different terms that stand in ``text`` between boundaries: all strict ones, and soft ones leftmost, then longest first, without overlaps."""
    spans, found, free = [], set(), 0
    for end, term in find.iter(text):
        start = end - len(term) + 1
        if (not start or text[start - 1] not in _ALNUM) and (end + 1 == len(text) or text[end + 1] not in _ALNUM):
            if term in strict:
                found.add(term)
            else:
                spans.append((start, -end, term))
    for start, end, term in sorted(spans):
        if start >= free:
            found.add(term)
            free = 1 - end
    return found


def _judge(strict: frozenset[str], soft: Mapping[str, int], soft_limit: int, soft_terms: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = _automaton([*strict, *soft])
        for batch in batches:
            hits, softs, weights, verdicts = [], [], [], []
            for url, by_rule in zip(batch.column("url").to_pylist(), batch.column("verdict").to_pylist(), strict=True):
                terms = _hits(find, (url or "").translate(_FOLD), strict) if len(find) else set()
                mild = terms - strict
                hits.append(len(terms & strict))
                softs.append(len(mild))
                weights.append(sum(soft[t] for t in mild))
                verdicts.append(by_rule or ("block" if hits[-1] or (softs[-1] >= soft_terms and weights[-1] >= soft_limit) else "allow"))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("page_id", "host", "path", "rule")), pa.array(verdicts, pa.string()), *(pa.array(x, pa.int64()) for x in (hits, softs, weights))], schema=_SCHEMA
            )

    return run


_FOLD = str.maketrans(_UPPER, _LOWER)


def _listed(terms: DataFrame | Sequence[tuple[str, str, int]]) -> Sequence[tuple[str, str, int]]:
    """The rows of a vocabulary; more than ``MAX_TERMS`` are refused."""
    if not isinstance(terms, DataFrame):
        return terms
    rows = terms.select(F.col("term").cast("string"), F.col("kind").cast("string"), F.col("weight").cast("int")).where("term <> ''").limit(MAX_TERMS + 1).collect()
    if len(rows) > MAX_TERMS:
        raise ValueError(f"a vocabulary has at most {MAX_TERMS} terms")
    return [tuple(r) for r in rows]


def filter_urls(
    pages: DataFrame,
    terms: DataFrame | Sequence[tuple[str, str, int]] = DEFAULT_TERMS,
    soft_limit: int = SOFT_LIMIT,
    soft_terms: int = SOFT_TERMS,
    rules: Sequence[tuple[str, str, str]] = RULES,
) -> DataFrame:
    """page_id, host, path, rule, verdict, numbers of different strict and soft terms, and the soft ones' weight.

    ``pages`` needs page_id and url; other columns are ignored.  Null and empty URLs have
    no host, fit no rule and are allowed.  ``terms``: term, kind ``strict`` or ``soft``, weight (null: 1); A-Z count as a-z; a
    term of both kinds is strict, of repeated soft ones the largest weight counts.  Without terms the rules decide alone.
    Repeated rows stay; a null page_id is passed on.
    """
    url = F.col("url").cast("string")
    host, path = url_parts(url)
    pages = pages.select(F.col("page_id").cast("long"), url.alias("url"), host.alias("host"), path.alias("path"))
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    words = [(t.translate(_FOLD), kind, 1 if w is None else w) for t, kind, w in _listed(terms)]
    strict = frozenset(t for t, kind, _ in words if kind == "strict")
    soft: dict[str, int] = {}
    for t, kind, w in words:
        if kind == "soft" and t not in strict:
            soft[t] = max(w, soft.get(t, 0))
    return pages.select("page_id", "url", "host", "path", rule.alias("rule"), verdict.alias("verdict")).mapInArrow(
        _judge(strict, soft, soft_limit, soft_terms), "page_id long, host string, path string, rule string, verdict string, strict_hits long, soft_hits long, soft_weight long"
    )


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


_FITS = "(host = '{0}' OR ends_with(host, '.{0}')) AND starts_with(path, '{1}')"
_BY_LENGTH = sorted(RULES, key=lambda r: -len(r[0] + r[1]))
#: Longer soft terms first: where one matches, what it holds is not matched again.
_ANY = "|".join(sorted({t for t, kind, _ in DEFAULT_TERMS if kind == "soft"}, key=lambda t: (-len(t), t)))
_STRICT = " + ".join(f"regexp_matches(low, '(^|[^a-z0-9]){t}([^a-z0-9]|$)')::BIGINT" for t, kind, _ in DEFAULT_TERMS if kind == "strict")
_TERMS = ", ".join(f"('{t}', '{kind}', {w})" for t, kind, w in DEFAULT_TERMS)
OP5_SQL = f"""
WITH terms(term, kind, weight) AS (VALUES {_TERMS}),
parts AS (
  SELECT page_id, url, translate(coalesce(url, ''), '{_UPPER}', '{_LOWER}') AS low,
    translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), '{_UPPER}', '{_LOWER}') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
-- every run of characters other than letters and digits is doubled, so that two terms may share a boundary
found AS (SELECT DISTINCT low, unnest(regexp_extract_all(regexp_replace(low, '([^a-z0-9])', '\\1\\1', 'g'), '(?:^|[^a-z0-9])({_ANY.replace('-', '--')})(?:[^a-z0-9]|$)', 1)) AS hit FROM (SELECT DISTINCT low FROM parts) AS p),
hits AS (SELECT low, count(*) AS soft_hits, sum(weight) AS soft_weight
  FROM found JOIN terms ON replace(hit, '--', '-') = term GROUP BY low),
judged AS (
  SELECT page_id, host, path,
    CASE {" ".join(f"WHEN {_FITS.format(h, p)} THEN '{h}{p}'" for h, p, _ in _BY_LENGTH)} END AS rule,
    CASE {" ".join(f"WHEN {_FITS.format(h, p)} THEN '{v}'" for h, p, v in _BY_LENGTH)} END AS ruled,
    CAST({_STRICT} AS BIGINT) AS strict_hits, CAST(coalesce(soft_hits, 0) AS BIGINT) AS soft_hits, CAST(coalesce(soft_weight, 0) AS BIGINT) AS soft_weight
  FROM parts LEFT JOIN hits USING (low))
SELECT page_id, host, path, rule,
  coalesce(ruled, CASE WHEN strict_hits > 0 OR (soft_hits >= {SOFT_TERMS} AND soft_weight >= {SOFT_LIMIT}) THEN 'block' ELSE 'allow' END) AS verdict,
  strict_hits, soft_hits, soft_weight
FROM judged
"""

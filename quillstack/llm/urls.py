"""URL verdicts: host and path rules first, then a weighted vocabulary.

An Aho-Corasick automaton counts strict and soft terms between boundaries; one strict hit or several
distinct soft hits of enough weight block a url. Escapes in the url are decoded before; vocabularies may come from a table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Rules (host, path, verdict) and terms of the vocabulary.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
STRICT = ("adult", "bdsm", "blowjob", "camgirl", "camgirls", "casino", "casinos", "cocaine", "escort", "escorts", "fetish", "gambling", "hardcore", "hentai", "heroin", "incest", "milf", "naked", "nude",
          "nudes", "onlyfans", "orgasm", "phishing", "porn", "porno", "pornstar", "roulette", "sex", "sexcam", "sexy", "shemale", "slut", "torrent", "torrents", "viagra", "warez", "webcam", "xxx")
#: Soft terms and their weights.
SOFT = {"ads": 1, "babes": 2, "bet": 1, "bets": 1, "betting": 2, "bingo": 1, "bonus": 1, "cheap": 1, "cialis": 2, "click": 1, "coupon": 1, "crack": 1, "crypto": 1, "dating": 1, "deal": 1, "discount": 1,
        "erotic": 2, "farm": 1, "free": 1, "hacked": 1, "hot": 1, "jackpot": 2, "keygen": 2, "lingerie": 1, "loan": 1, "loans": 1, "lottery": 1, "lucky": 1, "mature": 1, "payday": 1, "pharmacy": 1, "pills": 1,
        "poker": 1, "prize": 1, "promo": 1, "replica": 1, "singles": 1, "slots": 1, "spam": 1, "teen": 1, "track": 1, "win": 1, "winner": 1}
#: Weight of distinct soft terms that blocks, if there are two of them at least.
SOFT_LIMIT = 2
#: Terms that a vocabulary may have: some hundred bytes each in every worker.
MOST_TERMS = 1_000_000

_lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_escape = re.compile(r"%([0-9a-fA-F]{2})")
_alnum = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


def parts(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    at = (url or "").find("://")
    if at < 0:
        return "", ""
    rest = url[at + 3:]
    cut = min((i for i in map(rest.find, "?#") if i >= 0), default=len(rest))
    slash = rest.find("/", 0, cut)
    host = rest[:cut] if slash < 0 else rest[:slash]
    return host.translate(_lower), "" if slash < 0 else rest[slash:cut]


def plain(url: str | None) -> str:
    """A-Z lower-cased and escapes of ASCII characters decoded once."""
    text = url or ""
    if "%" in text:
        text = _escape.sub(lambda m: chr(n) if (n := int(m.group(1), 16)) < 128 else m.group(), text)
    return text.translate(_lower)


@lru_cache(maxsize=8)
def _automaton(strict: tuple[str, ...], soft: tuple[tuple[str, float], ...]) -> ahocorasick.Automaton:
    """Terms with their weights, None for strict ones; a term of both kinds is strict."""
    found = ahocorasick.Automaton()
    for term, weight in (*soft, *((t, None) for t in strict)):
        found.add_word(term, (term, weight))
    found.make_automaton()
    return found


def weigh(url: str | None, strict: tuple[str, ...] = STRICT, soft: tuple[tuple[str, float], ...] = tuple(SOFT.items())) -> tuple[int, int, float]:
    """Strict hits, distinct soft terms and their weight in a url; a hit has no letter or digit of ASCII beside it."""
    text = plain(url)
    n, seen = 0, {}
    for end, (term, weight) in _automaton(strict, soft).iter(text):
        start = end - len(term)
        if start >= 0 and text[start] in _alnum or end + 1 < len(text) and text[end + 1] in _alnum:
            continue
        if weight is None:
            n += 1
        else:
            seen[term] = weight
    return n, len(seen), sum(seen.values())


def vocabulary(terms: DataFrame, most: int = MOST_TERMS) -> tuple[tuple[str, ...], dict[str, float]]:
    """Strict and soft terms of a table (term, weight): a null weight makes a term strict, of several weights the largest counts.

    Every worker holds the terms, so a table of more than ``most`` different ones is an error; none are left out.
    """
    each = terms.where("term <> ''").groupBy(F.lower("term").alias("term")).agg(F.bool_or(F.col("weight").isNull()).alias("strict"), F.max("weight").alias("weight"))
    rows = each.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} terms")
    return tuple(sorted(r.term for r in rows if r.strict)), {r.term: r.weight for r in sorted(rows) if not r.strict}


def rule_of(host: str, path: str, rules=RULES) -> tuple[str, str] | None:
    """The longest rule, written host and path together, whose host is the url's or a parent of it, and its verdict."""
    fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else None


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, strict: tuple[str, ...] = STRICT, soft: dict[str, float] | None = None, soft_limit: float = SOFT_LIMIT) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, strict_hits, soft_hits, soft_weight.

    A null or empty url has an empty host and path, no rule, no hits and the verdict allow. Repeated rows and null
    ids are kept. No shuffle; only the url column is read.
    """
    weighed = tuple((SOFT if soft is None else soft).items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for url in b.column(1).to_pylist():
                host, path = parts(url)
                rule = rule_of(host, path, rules)
                hard, easy, weight = weigh(url, strict, weighed)
                bad = hard or easy > 1 and weight >= soft_limit
                out.append((host, path, rule and rule[0], rule[1] if rule else "block" if bad else "allow", hard, easy, weight))
            columns = list(zip(*out, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(c, t) for c, t in zip(columns, [pa.string()] * 4 + [pa.int64()] * 2 + [pa.float64()], strict=True))],
                names=["page_id", "host", "path", "rule", "verdict", "strict_hits", "soft_hits", "soft_weight"])

    kind = dict(pages.dtypes)[id_col]
    return pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("u")).mapInArrow(
        run, f"page_id {kind}, host string, path string, rule string, verdict string, strict_hits long, soft_hits long, soft_weight double")


def oracle() -> str:
    """The same in DuckDB SQL."""
    # escapes of ASCII characters, one after another; %25 comes last, so that nothing is decoded twice
    low = "coalesce(url, '')"
    for n in [*range(1, 37), *range(38, 128), 37]:
        low = f"regexp_replace({low}, '(?i)%{n:02x}', chr({n}), 'g')" if n != 92 else f"regexp_replace({low}, '(?i)%5c', '\\\\', 'g')"
    low = f"CASE WHEN contains(url, '%') THEN {low} ELSE coalesce(url, '') END"
    low = f"translate({low}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    hit = lambda terms: f"regexp_matches(low, '(^|[^a-z0-9])({'|'.join(terms)})([^a-z0-9]|$)')"
    count = lambda weights: " + ".join(f"{w} * {hit([t])}::int" for t, w in weights.items())
    longest = sorted(RULES, key=lambda r: len(r[0] + r[1]), reverse=True)
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    rule = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for h, p, _ in longest) + " END"
    verdict = "CASE rule " + " ".join(f"WHEN '{h}{p}' THEN '{v}'" for h, p, v in RULES)
    # each separator twice, as two neighbouring hits share one
    hits = " + ".join(f"len(regexp_extract_all(wide, '(^|[^a-z0-9]){t}([^a-z0-9]|$)'))" for t in STRICT)
    return f"""
WITH u AS (SELECT page_id, url, {low} AS low, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
c AS (SELECT page_id, low, regexp_extract(rest, '^[^?#]*') AS body FROM u),
p AS (SELECT page_id, low, translate(regexp_extract(body, '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             substr(body, length(regexp_extract(body, '^[^/]*')) + 1) AS path FROM c),
w AS (SELECT *, regexp_replace(low, '([^a-z0-9])', '\\1\\1', 'g') AS wide FROM p),
r AS (SELECT *, {rule} AS rule, ({hits})::bigint AS strict_hits, ({count(dict.fromkeys(SOFT, 1))})::bigint AS soft_hits, ({count(SOFT)})::double AS soft_weight FROM w)
SELECT page_id, host, path, rule, {verdict} ELSE CASE WHEN strict_hits > 0 OR soft_hits > 1 AND soft_weight >= {SOFT_LIMIT} THEN 'block' ELSE 'allow' END END AS verdict,
       strict_hits, soft_hits, soft_weight FROM r"""

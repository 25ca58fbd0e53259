"""Operator 8: URL filters by site rules and a weighted vocabulary.

A site rule (verdict, host, path) fits its host and all subdomains where the url's path starts with the rule's; the longest
rule that fits (host and path together; ties: block) gives the verdict. Other urls go through the vocabulary: an Aho-Corasick automaton
finds all terms in the lower-cased url, a hit counts if its boundaries hold (``word``: no ASCII letter or digit touches either end; ``start``: none touches the beginning;
``any``), and the weights of the distinct terms hit are summed. A url at ``LIMIT`` or more is blocked: one strict term weighs that much, a soft one 1.

The vocabulary is a table of (term, weight, boundary): ``VOCABULARY`` by default, or any other that ``read_vocabulary`` takes from a DataFrame. It goes to every worker, so its
size is bounded (``MOST_TERMS``).

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: from there up to ``?``, ``#`` or
the end. Defined results: a null url or one without ``://`` has an empty host and path and, with no hits, is allowed; each row is judged by
itself, repeated rows alike; very long urls are searched whole, in one pass; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelframe.llm.common import table

#: Weight at which a url is blocked; terms of a vocabulary at most.
LIMIT, MOST_TERMS = 2, 1_000_000
#: Terms that block alone, and terms of which several must stand together, by field; common words of harmless pages are left out or soft.
STRICT = (
    "porn", "porno", "pornos", "pornography", "pornstar", "xxx", "hentai", "camgirl", "camgirls", "milf", "nsfw", "escort", "escorts", "blowjob", "upskirt",
    "viagra", "cialis", "levitra", "tramadol", "xanax", "warez", "keygen", "keygens", "phishing", "malware", "ransomware", "spyware", "adserver", "popunder", "linkfarm", "sportsbook", "slots",
)
SOFT = (
    "adult", "adults", "sex", "sexy", "nude", "nudes", "erotic", "erotik", "fetish", "dating", "hookup", "webcam", "webcams", "lingerie", "swinger",
    "casino", "casinos", "kasino", "poker", "roulette", "blackjack", "jackpot", "bet", "bets", "betting", "bookmaker", "gambling", "wager", "lottery", "lotto", "wetten", "apuestas", "bingo",
    "pill", "pills", "pharmacy", "drugstore", "prescription", "steroids", "slimming", "diet", "detox", "supplements",
    "torrent", "torrents", "crack", "cracked", "cracks", "serials", "nulled", "pirate", "download", "downloads",
    "loan", "loans", "payday", "credit", "kredit", "debt", "forex", "crypto", "bitcoin", "airdrop", "earn", "cash", "money", "rich", "invest",
    "cheap", "cheapest", "discount", "replica", "replicas", "fake", "outlet", "wholesale", "coupon", "coupons", "deal", "deals", "offer", "offers", "sale", "billig", "gratis", "gratuit", "kostenlos",
    "free", "win", "winner", "winners", "prize", "prizes", "giveaway", "bonus", "promo", "reward", "rewards", "sweepstakes",
    "spam", "spammer", "seo", "backlink", "backlinks", "affiliate", "doorway", "ad", "ads", "advert", "adverts", "banner", "banners", "click", "clicks", "tracker", "trackers", "tracking", "popup", "popups", "sponsored",
)
#: (term, weight, boundary); words that other words begin with are looked for by their beginning.
VOCABULARY = (
    *((t, LIMIT, "word") for t in STRICT), *((t, 1, "word") for t in SOFT),
    ("pornhub", LIMIT, "start"), ("sexcam", LIMIT, "start"), ("onlinecasino", LIMIT, "start"), ("clickbait", 1, "start"), ("gambl", 1, "start"),
)
#: (verdict, host, path) of the contract.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
UPPER = {c: c + 32 for c in range(65, 91)}


def parts(url: str | None) -> tuple[str, str]:
    """(host, path)."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    end = min((i for i in (rest.find(c) for c in "?#") if i >= 0), default=len(rest))
    host, slash, path = rest[:end].partition("/")
    return host.translate(UPPER), slash + path


BOUNDARIES = ("word", "start", "any")
Vocabulary = Iterable[tuple[str, int, str]]


def checked(vocabulary: Vocabulary) -> dict[str, tuple[int, str]]:
    """(weight, boundary) by lower-cased term; of repeated terms the heaviest stays. Empty terms, weights below 1 and unknown boundaries are errors."""
    out: dict[str, tuple[int, str]] = {}
    for term, weight, boundary in vocabulary:
        if not term or weight is None or weight < 1 or boundary not in BOUNDARIES:
            raise ValueError(f"no vocabulary entry: {(term, weight, boundary)!r}")
        term = term.translate(UPPER)
        out[term] = max(out.get(term, (0, "")), (int(weight), boundary))
        if len(out) > MOST_TERMS:
            raise ValueError(f"a vocabulary holds {MOST_TERMS} terms at most")
    return out


def read_vocabulary(rows: DataFrame) -> list[tuple[str, int, str]]:
    """The vocabulary in a table with columns term, weight and maybe boundary (null: ``word``), ``MOST_TERMS`` rows at most."""
    boundary = F.coalesce("boundary", F.lit("word")) if "boundary" in rows.columns else F.lit("word")
    found = [tuple(r) for r in rows.select("term", F.col("weight").cast("int"), boundary).limit(MOST_TERMS + 1).collect()]
    if len(found) > MOST_TERMS:
        raise ValueError(f"a vocabulary holds {MOST_TERMS} terms at most")
    return found


def automaton(terms: dict[str, tuple[int, str]]):
    import ahocorasick

    out = ahocorasick.Automaton()
    for term, (weight, boundary) in terms.items():
        out.add_word(term, (term, boundary))
    if terms:
        out.make_automaton()
    return out


def _edge(c: str) -> bool:
    return not ("a" <= c <= "z" or "0" <= c <= "9")


def hits(url: str, words) -> set[str]:
    """Distinct vocabulary terms in the url whose boundaries hold."""
    low = url.translate(UPPER)
    found = set()
    for last, (term, boundary) in words.iter(low) if len(words) else ():
        first = last - len(term) + 1
        begins = boundary == "any" or first == 0 or _edge(low[first - 1])
        if begins and (boundary != "word" or last + 1 == len(low) or _edge(low[last + 1])):
            found.add(term)
    return found


def best_rule(host: str, path: str, rules: dict[str, list[tuple[str, str]]]) -> tuple[str, str] | None:
    """(rule text, verdict) of the longest rule; ``rules``: (path, verdict) by host."""
    best = None
    name = host
    while name:
        for prefix, verdict in rules.get(name, ()):
            if path.startswith(prefix):
                key = (len(name) + len(prefix), verdict == "block")
                if best is None or key > best[0]:
                    best = key, (name + prefix, verdict)
        name = name.partition(".")[2]
    return best and best[1]


def url_verdicts(pages: DataFrame, rules=RULES, vocabulary: Vocabulary = VOCABULARY, limit: int = LIMIT, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id, host, path, rule, verdict, weight (sum over the terms hit), strict and soft (terms hit that weigh ``limit`` or more, and less, sorted) of each row."""
    kind = pages.schema[id_col].dataType.simpleString()
    by_host: dict[str, list[tuple[str, str]]] = {}
    for verdict, host, path in rules:
        by_host.setdefault(host, []).append((path, verdict))
    terms = checked(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = automaton(terms)
        for batch in batches:
            cols: list[list] = [[], [], [], [], [], [], []]
            for url in batch.column(1).to_pylist():
                host, path = parts(url)
                rule = best_rule(host, path, by_host)
                found = sorted(hits(url, words)) if url else []
                weight = sum(terms[t][0] for t in found)
                verdict = rule[1] if rule else "block" if weight >= limit else "allow"
                hard, weak = [t for t in found if terms[t][0] >= limit], [t for t in found if terms[t][0] < limit]
                for col, v in zip(cols, (host, path, rule and rule[0], verdict, weight, hard, weak), strict=True):
                    col.append(v)
            arrays = [pa.array(c, t) for c, t in zip(cols, [pa.string()] * 4 + [pa.int64()] + [pa.list_(pa.string())] * 2, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=[id_col, "host", "path", "rule", "verdict", "weight", "strict", "soft"])

    return pages.select(id_col, F.col(url_col).alias("url")).mapInArrow(run, f"`{id_col}` {kind}, host string, path string, rule string, verdict string, weight long, strict array<string>, soft array<string>")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", "weight", F.concat_ws(",", "strict").alias("strict"), F.concat_ws(",", "soft").alias("soft"))


def op8_sql() -> str:
    low = "translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    edges = {"word": ("(^|[^a-z0-9])", "($|[^a-z0-9])"), "start": ("(^|[^a-z0-9])", ""), "any": ("", "")}
    terms = ", ".join(f"('{t}', {w}, '{edges[b][0]}{t}{edges[b][1]}')" for t, (w, b) in checked(VOCABULARY).items())
    rule = lambda host, path: f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}')"
    ordered = sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r[0] != "block"))
    which = " ".join(f"WHEN {rule(h, p)} THEN '{h}{p}'" for _, h, p in ordered)
    says = " ".join(f"WHEN {rule(h, p)} THEN '{v}'" for v, h, p in ordered)
    return f"""
WITH u AS (SELECT page_id, {low} AS low, coalesce(url, '') AS url,
             CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT *, regexp_extract(rest, '^[^?#]*') AS body FROM u),
h AS (SELECT *, translate(split_part(body, '/', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             substr(body, length(split_part(body, '/', 1)) + 1) AS path FROM b),
t AS (SELECT page_id, sum(weight)::BIGINT AS weight, coalesce(string_agg(term, ',' ORDER BY term) FILTER (WHERE weight >= {LIMIT}), '') AS strict,
        coalesce(string_agg(term, ',' ORDER BY term) FILTER (WHERE weight < {LIMIT}), '') AS soft
      FROM u JOIN (VALUES {terms}) v(term, weight, pattern) ON contains(low, term) AND regexp_matches(low, pattern) GROUP BY page_id)
SELECT h.page_id, host, path, CASE {which} END AS rule, CASE {says} WHEN t.weight >= {LIMIT} THEN 'block' ELSE 'allow' END AS verdict,
  coalesce(t.weight, 0) AS weight, coalesce(t.strict, '') AS strict, coalesce(t.soft, '') AS soft
FROM h LEFT JOIN t ON t.page_id = h.page_id"""

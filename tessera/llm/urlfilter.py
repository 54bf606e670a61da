"""URL filters: host and path rules, and a weighted vocabulary counted by an Aho-Corasick automaton."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# The rules (verdict, host, path).
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
# The vocabulary, by kind and weight. Terms of which one rejects:
STRICT = (
    "adult-x", "adultchat", "adultdating", "adultfriend", "blackjack", "camgirl", "camgirls", "camsex", "casino",
    "cialis", "clickbank", "crackz", "cumshot", "deepfake-nude", "ejaculation", "erotic", "erotica", "escort-service", "fetish",
    "freeporn", "fuck", "hardcore-sex", "hentai", "hookup", "keygen", "keygens", "levitra", "livecams", "livesex", "milf", "milfs",
    "nsfw", "nude", "nudes", "nudity", "onlinecasino", "orgasm", "orgy", "payday-loan", "payday-loans", "phentermine", "playboy",
    "porn", "porno", "pornhub", "pornos", "replica-watches", "rolex-replica", "sex", "sexcam", "sexcams", "sexshop", "sextoys",
    "sexy", "slut", "sluts", "sportsbook", "stripper", "swingers", "tramadol", "upskirt", "viagra", "voyeur", "warez", "webcamsex",
    "xanax", "xxx", "xxxvideos",
)
#: Terms of which several do, by weight.
SOFT = {
    0.5: (
        "about-us", "app", "archive", "blog", "buy", "click", "coupon", "coupons", "deal", "deals", "discount", "download", "downloads",
        "forum", "guest", "login", "news", "offer", "offers", "order", "promo", "register", "review", "reviews", "sale", "sales",
        "search", "shop", "signup", "store", "tag", "tags",
    ),
    1.0: (
        "ads", "adserver", "affiliate", "affiliates", "bet", "bets", "bonus", "cheap", "cracked", "credit", "dating", "diet",
        "earn-money", "farm", "flirt", "free", "giveaway", "hot", "insurance", "jackpot", "loan", "loans", "lottery", "lotto", "mature",
        "money", "mp3", "outlet", "prize", "prizes", "proxy", "replica", "singles", "slim", "sponsored", "torrent", "torrents", "track",
        "tracker", "tracking", "vip", "weightloss", "win", "winner",
    ),
    1.5: (
        "adult", "baccarat", "betting", "bingo", "escort", "escorts", "gamble", "gambling", "girls", "hacked", "lingerie", "pharmacy",
        "pill", "pills", "poker", "roulette", "slots", "spam", "spammer", "teen", "teens", "webcam", "webcams",
    ),
}
#: (term, strict, weight)
VOCABULARY = tuple((t, True, 0.0) for t in STRICT) + tuple((t, False, w) for w, terms in SOFT.items() for t in terms)
SOFT_HITS, SOFT_WEIGHT = 2, 2.0  # a url is rejected from so many distinct soft terms whose weights sum to that
MAX_TERMS = 1_000_000  # of a vocabulary given as a table: the automaton is held by every worker


def _lower(url: Column) -> Column:
    return F.translate(url, UPPER, LOWER)


def _rule(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; of equally long ones the first listed."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def _is_word(text: str, at: int) -> bool:
    return 0 <= at < len(text) and (text[at] in LOWER or text[at] in "0123456789")


def _terms(vocabulary) -> list[tuple[str, bool, float]]:
    """A vocabulary's rows, of a list or of a table (term, strict, weight), whose size is checked first."""
    if isinstance(vocabulary, DataFrame):
        rows = vocabulary.select("term", "strict", "weight").where("term <> ''").distinct().limit(MAX_TERMS + 1).collect()
        if len(rows) > MAX_TERMS:
            raise ValueError(f"a vocabulary of more than {MAX_TERMS} terms")
        vocabulary = [(r["term"], bool(r["strict"]), float(r["weight"] or 0.0)) for r in rows]
    return list(vocabulary)


def _counter(terms):
    """A function on batches of (page_id, lowered, host, path) that appends the distinct hits."""
    strict = {t for t, s, _ in terms if s}
    soft = {t: w for t, s, w in terms if not s}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ahocorasick.Automaton()
        for term in {*strict, *soft}:
            automaton.add_word(term, term)
        automaton.make_automaton()
        for batch in batches:
            out = []
            for text in batch.column("lowered").to_pylist():
                hits = set()
                for end, term in automaton.iter(text or "") if terms else ():
                    if not _is_word(text, end - len(term)) and not _is_word(text, end + 1):
                        hits.add(term)
                found = sorted(t for t in hits if t in soft)
                out.append((len(hits & strict), len(found), float(sum(soft[t] for t in found))))
            hits = [pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.float64()))]
            columns = [batch.column(c) for c in ("page_id", "host", "path")]
            yield pa.RecordBatch.from_arrays([*columns, *hits], ["page_id", "host", "path", "n_strict", "n_soft", "soft_weight"])

    return count


def judge_urls(pages: DataFrame, rules=RULES, vocabulary=VOCABULARY, soft_hits=SOFT_HITS, soft_weight=SOFT_WEIGHT) -> DataFrame:
    """A row for each row of pages (page_id, url; other columns are ignored): page_id, host, path,
    rule, verdict, n_strict, n_soft, soft_weight.

    The longest fitting rule decides; without one, the vocabulary does: a list or table of (term, strict,
    weight), terms in lower case. A term counts once, where neither a letter a-z nor a digit stands next to
    it, anywhere in the lower-cased url (A-Z only); terms may overlap and lie within each other. Rules and
    vocabulary are lists of checked size and travel with the code; nothing is shuffled. A null url or one
    without :// has an empty host and path; null has no hits and is allowed. Urls of any length are read
    whole; repeated rows are judged alike, a row each. Empty table: no rows.
    """
    url = F.col("url").cast("string")
    part = lambda k: F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", k), F.lit(""))
    parsed = pages.select(F.col("page_id").cast("long").alias("page_id"), _lower(part(1)).alias("host"), part(2).alias("path"), _lower(url).alias("lowered"))
    counted = parsed.mapInArrow(_counter(_terms(vocabulary)), "page_id long, host string, path string, n_strict long, n_soft long, soft_weight double")
    rule, verdict = _rule(F.col("host"), F.col("path"), rules)
    rejected = (F.col("n_strict") > 0) | ((F.col("n_soft") >= soft_hits) & (F.col("soft_weight") >= soft_weight))
    verdict = F.coalesce(verdict, F.when(rejected, "block").otherwise("allow"))
    return counted.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), "n_strict", "n_soft", "soft_weight")


def _oracle() -> str:
    terms = ", ".join(f"('{t}', {int(strict)}, {weight}::DOUBLE)" for t, strict, weight in VOCABULARY)
    rules = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
    return rf"""
        WITH parsed AS (
            SELECT page_id, translate(url, '{UPPER}', '{LOWER}') AS u,
                   translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host,
                   coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
            FROM pages),
        terms(term, strict, weight) AS (VALUES {terms}), rules(verdict, h, p) AS (VALUES {rules}),
        hits AS (
            SELECT page_id, sum(strict)::BIGINT AS n_strict, sum(1 - strict)::BIGINT AS n_soft, sum(weight) AS soft_weight
            FROM parsed JOIN terms ON regexp_matches(u, '(^|[^a-z0-9])' || term || '([^a-z0-9]|$)') GROUP BY page_id),
        fits AS (
            SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS verdict
            FROM parsed JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
        SELECT page_id, host, path, coalesce(n_strict, 0) AS n_strict, coalesce(n_soft, 0) AS n_soft, coalesce(soft_weight, 0.0) AS soft_weight, rule,
               coalesce(verdict, CASE WHEN n_strict > 0 OR (n_soft >= {SOFT_HITS} AND soft_weight >= {SOFT_WEIGHT}) THEN 'block' ELSE 'allow' END) AS verdict
        FROM parsed LEFT JOIN hits USING (page_id) LEFT JOIN fits USING (page_id)"""


ORACLE_SQL = _oracle()

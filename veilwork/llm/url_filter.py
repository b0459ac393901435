"""URL filter: allow and block rules by host and path, then a weighted vocabulary.

The vocabulary is searched in the lower-cased URL by one Aho-Corasick automaton, built once in a
worker. A hit counts only between word boundaries (no ASCII letter or digit beside it). One strict
term, or ``min_soft`` distinct soft terms, reject the URL; the score adds the weights of the
distinct terms found.

Defined cases: a null URL, or one without ``://``, has the empty host and path, no rule and no hits
unless the text holds a term; repeated rows are judged one by one; extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Host, path, verdict.
DEFAULT_RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)

#: Terms that reject a URL alone, and the weights of terms that reject in company; tracking tags are in neither.
_STRICT = (
    "porn porno pornhub xxx hentai milf camgirl camgirls webcamsex escort escorts callgirl nsfw nude nudes onlyfans fetish bdsm "
    "casino casinos jackpot roulette blackjack sportsbook viagra cialis tramadol xanax oxycodone warez keygen nulled malware phishing "
    "botnet cracked serials"
)
_SOFT = {
    0.5: "adult sex sexy erotic naked bet bets betting poker slots gambling lottery loan loans payday dating hookup singles torrent torrents "
         "crack hack hacks pills pharmacy replica steroids bitcoin forex ringtones spyware proxy",
    0.25: "cheap discount coupon free win winner prize bonus deal deals clearance giveaway download downloads",
}
#: Term, weight; a weight of 1 or more is strict.
DEFAULT_VOCABULARY = tuple([(t, 1.0) for t in _STRICT.split()] + [(t, w) for w, terms in _SOFT.items() for t in terms.split()])

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?``, ``#`` or the end; A-Z lower-cased."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null where none does. ``rules`` is a short configuration list."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r_host, r_path, r_verdict in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):
        fits = ((host == r_host) | host.endswith("." + r_host)) & path.startswith(r_path)
        rule = F.when(fits, F.lit(r_host + r_path)).otherwise(rule)
        verdict = F.when(fits, F.lit(r_verdict)).otherwise(verdict)
    return rule, verdict


def _vocabulary_udf(vocabulary: Sequence[tuple[str, float]]):
    terms = [(t.lower(), float(w)) for t, w in vocabulary]

    @F.pandas_udf("n_strict int, n_soft int, url_score double")
    def search(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for i, (term, _) in enumerate(terms):
            automaton.add_word(term, i)
        automaton.make_automaton()
        word = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")

        def judge(url):
            low, found = (url or "").lower(), set()
            for end, i in automaton.iter(low):
                start = end + 1 - len(terms[i][0])
                if (start == 0 or low[start - 1] not in word) and (end + 1 == len(low) or low[end + 1] not in word):
                    found.add(i)
            weights = [terms[i][1] for i in sorted(found)]
            strict = sum(w >= 1 for w in weights)
            return strict, len(weights) - strict, sum(weights)

        for urls in batches:
            yield pd.DataFrame(map(judge, urls), columns=["n_strict", "n_soft", "url_score"])

    return search


def judge_urls(
    pages: DataFrame,
    url_col: str = "url",
    rules: Sequence[tuple[str, str, str]] = DEFAULT_RULES,
    vocabulary: Sequence[tuple[str, float]] = DEFAULT_VOCABULARY,
    min_soft: int = 2,
) -> DataFrame:
    """Adds host, path, rule, verdict, n_strict, n_soft and url_score; columns of these names are replaced."""
    url = F.col(f"`{url_col}`")
    host, path = url_host(url), url_path(url)
    rule, verdict = rule_for(host, path, rules)
    hits = _vocabulary_udf(vocabulary)(url)
    own = F.when((F.col("__hits.n_strict") > 0) | (F.col("__hits.n_soft") >= min_soft), "block").otherwise("allow")
    out = pages.withColumn("__hits", hits)
    new = {
        "host": host, "path": path, "rule": rule, "verdict": F.coalesce(verdict, own),
        "n_strict": F.col("__hits.n_strict"), "n_soft": F.col("__hits.n_soft"), "url_score": F.col("__hits.url_score"),
    }
    return out.withColumns(new).drop("__hits")

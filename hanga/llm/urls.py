"""URL filter: rules first, then logistic regression on hashed character
n-grams of host and path, trained from a small labelled URL table.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z
lower-cased; path: from there up to ``?``, ``#`` or the end. A null url, or
one without ``://``, has both empty. A rule (host, path) fits its host and all
subdomains when the url's path starts with the rule's path; of the rules that
fit, the longest (host + path) wins, then the first given.

The labelled table is a list of (url, 1 = block) or a DataFrame with the
columns ``url`` and ``block``; of a DataFrame at most ``TABLE_ROWS`` distinct
urls are used, those with the smallest hashes. The default one,
:func:`labelled_urls`, is made by a rule from words, top-level domains, host
shapes and path shapes.

Defined results: null and malformed urls have empty host and path, fit no rule
and get the model's verdict on empty strings (decided by the bias); very long
urls are scored whole, a piece of ``PIECE`` characters at a time; repeated
rows, null ids and extra columns are kept as they are; an empty table gives an
empty result; an empty or one-sided label table gives a constant verdict
(``allow`` if there is no blocked example); labelled rows with a null url or
label are left out, and a url labelled both ways counts as blocked.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_texts, shielded
from .labelled import smallest_hashes
from .wordgrams import Adam, sigmoid

DIMS = 1 << 14
LOW, HIGH = 3, 5
STEPS, RATE, DECAY = 600, 0.1, 1e-6
BLOCK_SHARE = 0.4      # weight of the blocked examples in the fit, whatever their number
THRESHOLD = 0.5
TABLE_ROWS = 20_000     # labelled urls used for a fit, at most
PIECE = 1 << 18         # characters hashed at a time

# Words of hosts to block (advertising, tracking, gambling,
# pharmacy, adult, loan, counterfeit and malware sites) and of plain ones.
BLOCK_WORDS = """casino poker slots roulette jackpot blackjack bets betting bingo lottery
    pills pharmacy viagra cialis meds adserver ads banners popunder clicktrack tracker affiliate
    xxx porn adult cams escort hookup payday loans fastcash replica fakewatches cracked keygen
    warez torrent malware phishing spam prize giveaway clickbait""".split()
PLAIN_WORDS = """library museum university school college city council hospital clinic theatre
    music concert travel hotel garden kitchen recipe bakery coffee market weather climate science
    physics biology chemistry history archive journal news times herald radio sports football
    cycling hiking photo camera gallery design studio software docs developer forum wiki blog
    books reading poetry language translate learn course teacher student research institute
    energy solar water river mountain forest animal bird farm food health family kids house
    furniture car train airport map atlas law justice government parliament police bank insurance
    jobs career office startup company shop fashion shoes jewel paint craft knitting chess""".split()
TOP_DOMAINS = ["com", "org", "net", "info", "io", "co.uk", "de", "fr", "es", "ru", "site", "online"]
BLOCK_SHAPES = ["{w}.{t}", "www.{w}-{o}.{t}", "{o}-{w}.{t}", "best{w}{n}.{t}", "{w}{n}.{t}", "m.free-{w}.{t}",
                "online-{w}.{o}.{t}", "{w}-4u.{t}", "get{w}now.{t}", "win-{w}.example.{t}"]
PLAIN_SHAPES = ["{w}.{t}", "www.{w}{o}.{t}", "{o}-{w}.{t}", "the{w}.{t}", "{w}{n}.{t}", "m.{w}.{t}",
                "blog.{o}{w}.{t}", "my{w}.{t}", "{w}.example.{t}", "online.{w}.{t}"]
PATH_SHAPES = ["", "/", "/en/{n}", "/{n}.html", "/{o}/", "/de/{o}-{n}.html", "/fr/{n}?ref=x", "/index.php?id={n}",
               "/2024/05/{o}", "/a/b/{n}#top"]


def labelled_urls(per_word: int = 24, block_words: list[str] | None = None,
                  plain_words: list[str] | None = None) -> list[tuple[str, int]]:
    """``per_word`` urls (url, 1 = block) of every word: its host and path
    shapes, domain and second word (a plain one) follow from a hash."""
    bad = BLOCK_WORDS if block_words is None else block_words
    plain = PLAIN_WORDS if plain_words is None else plain_words
    out = []
    for words, shapes, label in ((bad, BLOCK_SHAPES, 1), (plain, PLAIN_SHAPES, 0)):
        for word in words:
            for i in range(per_word):
                def pick(values, what, key=f"{word}:{i}"):
                    return values[zlib.crc32(f"{key}:{what}".encode()) % len(values)]
                parts = {"w": word, "o": pick(plain, "other"), "t": pick(TOP_DOMAINS, "domain"),
                         "n": 1 + pick(range(999), "number")}
                out.append((pick(["http", "https"], "scheme") + "://" + pick(shapes, "host").format(**parts)
                            + pick(PATH_SHAPES, "path").format(**parts), label))
    return sorted(set(out))


def read_table(table: DataFrame, rows: int = TABLE_ROWS, url: str = "url", block: str = "block") -> list[tuple[str, int]]:
    """At most ``rows`` distinct labelled urls of a DataFrame, in fixed order."""
    marked = (table.where(F.col(url).isNotNull() & F.col(block).isNotNull())
              .groupBy(F.col(url).alias("url")).agg(F.max(F.col(block).cast("int")).alias("block")))
    return sorted((r["url"], r["block"]) for r in smallest_hashes(marked, rows, "url").collect())


def split_url(url: str | Column) -> tuple[Column, Column]:
    """(host, path) columns of a url column."""
    c = F.col(url) if isinstance(url, str) else url
    found = F.coalesce(F.instr(c, "://"), F.lit(0))
    rest = F.when(found > 0, F.substr(c, found + 3)).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
                       "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def matched_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest of ``rules`` (verdict, host, path) that
    fits; both null when none does."""
    rule = verdict = F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2]))[::-1]:
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, F.lit(h + p)).otherwise(rule)
        verdict = F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def _hash_grams(code: np.ndarray, part: int, dims: int) -> list[np.ndarray]:
    """Per size, the slot of the n-gram that begins at every code point."""
    out = []
    h = code + np.uint64(1 + part)
    for size in range(2, HIGH + 1):
        if len(code) < size:
            break
        h = h[:len(code) - size + 1] * np.uint64(0x9E3779B97F4A7C15) + code[size - 1:] + np.uint64(1)
        if size >= LOW:
            x = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            out.append(((x ^ (x >> np.uint64(32))) % np.uint64(dims)).astype(np.int64))
    return out


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def _long_slots(text: str, part: int, dims: int) -> np.ndarray:
    """Distinct slots of one text, ``PIECE`` characters at a time."""
    seen = np.zeros(dims, bool)
    for lo in range(0, max(len(text), 1), PIECE):
        for slots in _hash_grams(_codes(text[lo:lo + PIECE + HIGH - 1]), part, dims):
            seen[slots] = True
    return np.flatnonzero(seen)


def bulk_slots(hosts: list[str], paths: list[str], dims: int = DIMS) -> tuple[np.ndarray, np.ndarray]:
    """(row, slot) pairs, sorted and distinct, of the character n-grams of
    ``<host>`` and of the path (the two hash apart) of many urls, hashed in a
    few numpy passes over all their code points."""
    pairs = []
    for part, texts in ((1, [f"<{h}>" for h in hosts]), (2, paths)):
        lo = 0
        while lo < len(texts):
            hi, size = lo, 0
            while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= PIECE):
                size += len(texts[hi])
                hi += 1
            if size > PIECE:                     # one long text
                pairs.append(_long_slots(texts[lo], part, dims) + lo * dims)
            else:
                lengths = np.array([len(t) for t in texts[lo:hi]])
                owner = np.repeat(np.arange(lo, hi), lengths)
                for k, slots in enumerate(_hash_grams(_codes("".join(texts[lo:hi])), part, dims)):
                    first = owner[:len(slots)]
                    inside = first == owner[LOW + k - 1:]
                    pairs.append(first[inside] * dims + slots[inside])
            lo = hi
    both = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
    return both // dims, both % dims


@dataclass
class UrlModel:
    weights: np.ndarray
    bias: float

    def probabilities(self, hosts: list[str], paths: list[str]) -> np.ndarray:
        """Distinct n-grams, scaled by their number: long urls are not louder."""
        rows, slots = bulk_slots(hosts, paths, len(self.weights))
        total = np.bincount(rows, self.weights[slots], len(hosts))
        number = np.maximum(np.bincount(rows, minlength=len(hosts)), 1)
        return sigmoid(total / np.sqrt(number) + self.bias)

    def probability(self, host: str, path: str) -> float:
        return float(self.probabilities([host], [path])[0])


def _host_path(url: str | None) -> tuple[str, str]:
    at = (url or "").find("://")
    rest = url[at + 3:] if at >= 0 else ""
    end = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
    host, tail = rest[:end], rest[end:]
    stop = min([i for i in map(tail.find, "?#") if i >= 0], default=len(tail))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), tail[:stop]


def fit(table: list[tuple[str, int]], dims: int = DIMS) -> UrlModel:
    """Full-batch logistic regression with L2 decay; the blocked examples
    together weigh ``BLOCK_SHARE``, so hosts without known parts are allowed."""
    y = np.array([v for _, v in table], float)
    if not len(y) or y.min() == y.max():
        return UrlModel(np.zeros(dims), 30.0 if len(y) and y[0] == 1 else -30.0)
    parted = [_host_path(url) for url, _ in table]
    rows, slots = bulk_slots([h for h, _ in parted], [p for _, p in parted], dims)
    share = (1 / np.sqrt(np.maximum(np.bincount(rows, minlength=len(y)), 1)))[rows]
    mass = np.where(y == 1, BLOCK_SHARE / y.sum(), (1 - BLOCK_SHARE) / (len(y) - y.sum()))
    x = np.zeros(dims + 1)
    adam = Adam(dims + 1, RATE)
    for _ in range(STEPS):
        z = np.bincount(rows, x[slots] * share, len(y)) + x[-1]
        slope = mass * (sigmoid(z) - y)
        grad = np.append(np.bincount(slots, slope[rows] * share, dims) + DECAY * x[:dims], slope.sum())
        x = adam.step(x, grad)
    return UrlModel(x[:dims], float(x[-1]))


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]] = (),
                table: list[tuple[str, int]] | DataFrame | None = None, threshold: float = THRESHOLD,
                url: str = "url") -> DataFrame:
    """Append host, path, rule, score (probability to block, model only) and
    verdict (``allow`` or ``block``) to ``pages``. ``table`` holds the labelled
    urls; None stands for :func:`labelled_urls`."""
    labelled = labelled_urls() if table is None else read_table(table) if isinstance(table, DataFrame) else table
    # DIMS weights
    shared = pages.sparkSession.sparkContext.broadcast(fit(labelled))
    rule, ruled = matched_rule(F.col("host"), F.col("path"), list(rules))

    def probability(hosts, paths):
        return [pa.array(shared.value.probabilities(hosts, paths), pa.float64())]

    def run(d):
        host, path = split_url(url)
        parted = (d.withColumn("host", host).withColumn("path", path)
                  .withColumn("rule", rule).withColumn("_ruled", ruled))
        scored = map_texts(parted, ["host", "path"], probability, "score double")
        by_model = F.when(F.col("score") >= threshold, "block").otherwise("allow")
        return scored.withColumn("verdict", F.coalesce("_ruled", by_model)).drop("_ruled")

    return shielded(pages, [url], run, ("host", "path", "rule", "score", "verdict"))

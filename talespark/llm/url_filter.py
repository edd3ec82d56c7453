"""URL filtering: explicit host and path rules, else a logistic regression on
hashed character n-grams of host and path.

The regression is fitted on a small labelled URL table (at most ``MAX_LABELLED``
rows) and scores every URL inside Spark tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pick, read
from .grams import hashed_grams

#: Bound of the labelled table that the model is fitted on.
MAX_LABELLED = 2000
#: The n-gram lengths and the penalty do best on words left out of the table, five folds.
BITS, ORDERS = 13, (3, 4)
#: Block from this probability on: of ordinary words that the table lacks, one in twenty reaches it.
THRESHOLD = 0.56

#: (host, path, verdict); a rule fits its host and all subdomains.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]

#: The default labelled table, as text: words that unwanted and ordinary hosts are named
#: with. It names no host of any given table, and no unwanted word is part of such a host.
BLOCK_WORDS = """
gamble gambler gambling poker pokerroom pokies slots slotmachine megaslots jackpot jackpots roulette blackjack baccarat bingo lotto lottery
wager wagering bookie bookmaker sportsbook
porn porno pornstar pornvideos sex sexy sexcam sexchat nude nudes nudist escort escorts escortgirls camgirls webcamgirls livecams hentai milf
milfs erotic erotica fetish hookup hookups stripper striptease naked nakedgirls hotgirls horny
viagra kamagra cialis levitra xanax valium ambien oxycodone opioid steroid steroids sildenafil modafinil phentermine weightloss slimming
fatburner enlargement
malware ransomware spyware scareware keylogger keygen keygens crack cracks cracked warez torrent torrents trojan exploit exploits phish
phishing botnet rootkit hijack hacked hacks nulled serials pirated
scam scams scammer payday paydayloan loan loans quickloan cashadvance fastcash quickcash easycash easymoney moneymaker makemoney forex
forexsignals binaryoptions ponzi getrich richquick cryptodoubler bitcoindoubler airdrop replica replicas replicawatch counterfeit fakeid
fakepassport knockoff
popup popups popunder clickbait clickfraud clicker banner bannerexchange backlinks paidlinks doorway affiliate affiliates junkmail massmail
mailblast bulkmail
""".split()
ALLOW_WORDS = """
news newspaper daily journal journalism library librarian museum museums school schools college campus science scientist nature history
garden gardening kitchen recipe recipes cooking travel hotel hotels weather forecast sports football cricket tennis music theater cinema
movie book books bookstore reading writer paper forum wiki health healthcare hospital clinic doctor dentist nursing family parent kids
children city county village river mountain mountains coffee bakery bread studio design photo photography market grocery store repair energy
solar water
other brother mother father leather northern southern western eastern thread three think things theory thesis thermal there nation station
education foundation translation transportation restaurant research teacher learning student engineering builder building furniture table
house housing property insurance lawyer court government council election policy church charity volunteer community society culture heritage
tradition archive archives record document dictionary language grammar poetry
mathematics physics chemistry biology zoology geology astronomy planet ocean island forest animal birds horse puppy kitten insect flower
orchard harvest tractor
bicycle cycling running hiking camping climbing sailing fishing yoga fitness dance painting sculpture pottery knitting quilting craft toolbox
hardware software computer developer programming database network server mobile phone camera radio podcast magazine editor printing
delivery railway airport harbor bridge highway garage vehicle
""".split()
#: What stands around the words is alike on both sides.
AFFIXES = [("my", ""), ("", "online"), ("the", ""), ("", "hub"), ("best", ""), ("", "24"), ("top", ""), ("", "world")]
FRONTS, ENDS = ("", "www.", "m.", "blog.", "shop."), ("com", "org", "net", "info", "example.com", "example.org")
PATHS = ("", "/", "/en/%d", "/de/%d.html", "/fr/%d", "/es/%d/", "/index.html")


def default_labels(left_out: frozenset[str] = frozenset()) -> list[tuple[str, int]]:
    """The small labelled URL table: (url, 1 = block). Each word stands alone, with an affix,
    and joined to another of its side. Names with a word that is ``left_out`` are not given."""
    out = []
    for label, words in ((1, BLOCK_WORDS), (0, ALLOW_WORDS)):
        for i, word in enumerate(words):
            (before, after), other = AFFIXES[i % len(AFFIXES)], words[(i + 17) % len(words)]
            for j, (name, used) in enumerate(((word, {word}), (before + word + after, {word}), (word + ("", "-")[i % 2] + other, {word, other}))):
                k = 3 * i + j
                path = PATHS[k % len(PATHS)].replace("%d", str(13 * k))
                if not used & left_out:
                    out.append((f"https://{FRONTS[k % len(FRONTS)]}{name}.{ENDS[k % len(ENDS)]}{path}", label))
    return out


def url_parts(url: str | Column) -> tuple[Column, Column]:
    """(host, path): host follows the first ``://`` up to ``/ ? #`` or the end, with A-Z
    lower-cased; path then runs up to ``? #`` or the end. Null or no ``://``: both empty."""
    c = F.col(url) if isinstance(url, str) else url
    at = F.locate("://", c)
    rest = F.when(at > 0, F.substring(c, at + 3, F.length(c))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_columns(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest rule that fits; null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):  # longer ones come later and win
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def features(host: str, path: str) -> np.ndarray:
    """Distinct buckets of host and path n-grams (the two have separate hash salts)."""
    return np.unique(np.concatenate([hashed_grams(f"^{host}$".encode(), ORDERS, BITS, 1), hashed_grams(f"^{path}$".encode(), ORDERS, BITS, 2)]))


def fit(labelled: list[tuple[str, str, int]], l2: float = 1e-4, steps: int = 400, rate: float = 4.0) -> np.ndarray:
    """Weights with the bias last, by gradient descent over the whole labelled table."""
    if len(labelled) > MAX_LABELLED:
        raise ValueError(f"the labelled URL table has {len(labelled)} rows; the bound is {MAX_LABELLED}")
    x = np.zeros((len(labelled), 2**BITS + 1), np.float32)
    y = np.array([r[2] for r in labelled], np.float32)
    for i, (host, path, _) in enumerate(labelled):
        at = features(host, path)
        x[i, at] = 1 / np.sqrt(max(len(at), 1))
    x[:, -1] = 1
    w = np.zeros(x.shape[1], np.float32)
    if not len(labelled):
        return w
    weight = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))  # classes count alike
    for _ in range(steps):
        g = x.T @ (weight * (1 / (1 + np.exp(-(x @ w))) - y))
        g[:-1] += l2 * w[:-1]
        w -= rate * g
    return w


def filter_urls(
    pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, labels: list[tuple[str, int]] | None = None, id_col: str = "page_id", url_col: str = "url", threshold: float = THRESHOLD
) -> DataFrame:
    """One row per page: id, url, host, path, rule, p_block, verdict.

    The verdict is the longest fitting rule's, else ``block`` where the model's
    probability reaches ``threshold``. Null and unparsable URLs have empty host and
    path, fit no rule and are judged by the model on empty text. Repeated rows are
    judged alike and all kept; other columns are ignored.
    """
    spark = pages.sparkSession
    labels = default_labels() if labels is None else labels
    table = spark.createDataFrame(labels, "url string, label int").select(*url_parts("url"), "label").toDF("host", "path", "label")
    w = fit([tuple(r) for r in table.limit(MAX_LABELLED + 1).collect()])

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            p = np.empty(len(pdf))
            for i, (host, path) in enumerate(zip(pdf["host"], pdf["path"])):
                at = features(host, path)
                p[i] = w[at].sum() / np.sqrt(max(len(at), 1)) + w[-1]
            yield pdf.assign(p_block=1 / (1 + np.exp(-p)))

    host, path = url_parts("url")
    parts = pick(pages, id_col, url_col).toDF("page_id", "url").select("page_id", "url", host.alias("host"), path.alias("path"))
    kind = parts.schema["page_id"].dataType.simpleString()
    scored = parts.mapInPandas(score, f"page_id {kind}, url string, host string, path string, p_block double")
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    by_model = F.when(F.col("p_block") >= threshold, "block").otherwise("allow")
    return scored.select(F.col("page_id").alias(id_col), F.col("url").alias(url_col), "host", "path", rule.alias("rule"), "p_block", F.coalesce(verdict, by_model).alias("verdict"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(read(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", "p_block")

"""URL filters: prefix rules first, else logistic regression on hashed character n-grams.

The host is what stands after the first `://` up to `/`, `?`, `#` or the end, with
A-Z lower-cased; the path goes on from there up to `?`, `#` or the end. A rule
fits its host and all subdomains if the path starts with the rule's path; of
several the longest wins. Where no rule fits, the model decides; it is trained
from a small labelled URL table when the query starts (a few seconds) and
scores in Arrow batches.

Defined results: a null url, or one without `://`, has an empty host and path, no
rule, and is allowed, whatever the model's figure. A URL that names none of the words
that the table blocks, nor one like them in its n-grams, is allowed.
Rows that repeat are judged apart, alike. Further columns of pages are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalith.llm.hashing import char_counts, sparse_unit
from catalith.llm.logistic import Rows, fit, sigmoid

BITS = 14
BLOCK_AT = 0.5
#: (host, path, verdict)
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))

# The words of the labelled URL table.
BLOCK_WORDS = """casino poker jackpot slots roulette blackjack betting bets bookmaker gamble gambling porn porno xxx sex escort nude nudes adult erotic hentai cams camgirls viagra cialis pills pharma
cheapmeds steroids payday loans freemoney getrich forex crack cracked keygen warez torrent torrents serial nulled phish phishing malware spyware hack hacks free-gift giftcard winner prize lottery lotto replica""".split()
ALLOW_WORDS = """news library school university museum science health weather garden recipes travel history music sport market city research journal archive forum docs help support project software kernel
data maps books theatre gallery parish council hospital railway nature physics essex sussex classics assessment cracow therapist cocktail analysis button advice lottie poland slovenia""".split()
ENDS = "com org net info co.uk de fr es it io eu".split()
_ONSETS = "b br c ch d dr f fl g gr h j k kl l m n p pl qu r s sch sl st t th tr v w y z".split()
_NUCLEI = "a e i o u ai ea ie ou".split()
_CODAS = ["", "", "l", "m", "n", "nd", "r", "rt", "s", "ss", "t", "x", "ck"]


def labelled_urls(names: int = 2500, seed: int = 2) -> list[tuple[str, str, bool]]:
    """The labelled table (host, path, blocked), built by rule.

    Both classes have the same shapes, ends and made-up names; they differ in what they
    name. A blocked URL has a blocked word in its host or path, beside words of any kind; an
    allowed one has allowed words or made-up names (so many) alone.
    """
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    name = lambda: "".join(pick(_ONSETS) + pick(_NUCLEI) + pick(_CODAS) for _ in range(int(rng.integers(1, 4))))
    sub = lambda: pick(("", "", "www.", "m.", "blog.", "shop.", "en."))
    n, lang, page = lambda: str(int(rng.integers(1, 100_000))), lambda: pick(("en", "de", "fr", "es", "it")), lambda: pick(("", "/", ".html", ".php"))
    shapes = (
        lambda w, v: (f"{sub()}{w}{name()}.{pick(ENDS)}", pick(("", "/"))),
        lambda w, v: (f"{sub()}{name()}{w}.{pick(ENDS)}", f"/{name()}"),
        lambda w, v: (f"{sub()}{w}-{v}.{pick(ENDS)}", f"/{lang()}/{n()}{page()}"),
        lambda w, v: (f"{sub()}{v}-{w}.{name()}.{pick(ENDS)}", f"/{lang()}/{n()}{page()}"),
        lambda w, v: (f"{sub()}{w}.{name()}.{pick(ENDS)}", f"/{name()}/{n()}"),
        lambda w, v: (f"{w}{v}.{pick(ENDS)}", f"/{n()}{page()}"),
        lambda w, v: (f"{sub()}{name()}.{pick(ENDS)}", f"/{w}/{v}-{n()}{page()}"),
        lambda w, v: (f"{sub()}{name()}.{pick(ENDS)}", f"/{w}{page()}"),
        lambda w, v: (f"{name()}.{name()}.{pick(ENDS)}", f"/{lang()}/{v}-{w}/"),
    )
    kinds = (lambda: pick(BLOCK_WORDS), lambda: pick(ALLOW_WORDS), name)
    rows = [(*shape(w, pick(kinds)()), True) for w in BLOCK_WORDS for shape in (*shapes, *shapes)]
    rows += [(*shape(w, pick(kinds[1:])()), False) for w in ALLOW_WORDS for shape in shapes]
    return rows + [(*shapes[i % len(shapes)](name(), pick(kinds[1:])()), False) for i in range(names)]


def features(host: str, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Grams of 3 to 5 bytes of host and path; host and path have buckets of their own."""
    idx, val = [], []
    for k, part in enumerate((f"^{host}$", f"{path.lower()}$")):
        data = part.encode("utf-8", "surrogatepass")
        i, v = sparse_unit(sum(char_counts(data, n, BITS) for n in (3, 4, 5)))
        idx.append(i + np.int32(k << BITS))
        val.append(v)
    return np.concatenate(idx), np.concatenate(val)


class UrlModel:
    def __init__(self, labelled: list[tuple[str, str, bool]]):
        rows = [features(h, p) for h, p, _ in labelled]
        blocked = np.array([y for *_, y in labelled], float)
        self.w, self.b = fit(Rows(rows, 2 << BITS), blocked, weight=1 + 2 * blocked, l2=1e-7, steps=200)

    def probability(self, host: str, path: str) -> float:
        idx, val = features(host, path)
        return float(sigmoid(val @ self.w[idx] + self.b))


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; null and null if none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def filter_urls(pages: DataFrame, rules=RULES, labelled=None) -> DataFrame:
    """(page_id, host, path, rule, verdict, block_probability), a row for each row of pages; the last is null where a rule decides."""
    model = pages.sparkSession.sparkContext.broadcast(UrlModel(labelled or labelled_urls()))

    @F.pandas_udf("double")
    def probability(hosts: pd.Series, paths: pd.Series, decided: pd.Series) -> pd.Series:
        judge = model.value.probability
        return pd.Series([None if d else judge(h, p) for h, p, d in zip(hosts, paths, decided, strict=True)], dtype="float64")

    host, path = host_and_path(F.col("url").cast("string"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "by_rule": verdict})
    rows = rows.withColumn("p", probability("host", "path", F.col("rule").isNotNull()))
    p = F.when(F.col("rule").isNull(), F.col("p"))
    block = (p >= BLOCK_AT) & (F.concat("host", "path") != "")
    return rows.select("page_id", "host", "path", "rule", F.coalesce("by_rule", F.when(block, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), p.alias("block_probability"))

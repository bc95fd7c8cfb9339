"""URL filters (operator 5, native).

Logistic regression on hashed character n-grams of host and path, trained from a small
labelled URL table, with an ordered set of host and path rules that overrule it.

Everything is DataFrame expressions and Spark ML transformers, which run in the JVM.
A URL is scored in the row that holds it; nothing is shuffled.
"""

from __future__ import annotations

import itertools
import string

import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Verdict, host, path. The host and its subdomains match where the path begins so.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

NGRAMS, BUCKETS, REGULARISATION = (3, 4, 5), 1 << 16, 3e-6
#: Most rows of a labelled table that is trained on.
MOST_LABELLED = 20_000

#: Words of unwanted sites, of ordinary ones, and ordinary sites that are widely known.
_UNWANTED = (
    "casino poker jackpot betting bets gambling slots lottery sportsbook roulette blackjack wager adult porn porno xxx escort "
    "escorts webcam camgirls hentai milf nude nudes fetish hookup erotic viagra cialis steroids pills pharma payday quickloan "
    "replica knockoff clickbait popunder adserver adtrack adclick malware phishing keylogger warez keygen cracked torrent "
    "pirated ads banner affiliate cheappills discountpills giveaway winprize freebonus cashbonus spam linkfarm doorway getrich makemoney forexsignal cryptodouble"
).split()
_ORDINARY = (
    "library museum university school science journal weather recipes garden history physics biology council hospital farm "
    "news archive travel music poetry sports forum docs wiki research kitchen family market language mountain river fishing "
    "health review project teacher student observatory theatre railway astronomy chemistry cooking gallery village bakery "
    "address book city county library bank insurance pharmacist therapist analyst address express sussex middlesex cocktail "
    "passion assembly class glass compass discount offer ticket hotel flight airport bicycle football cricket rugby tennis "
    "software hardware network database compiler kernel linux debian python java forum support help guide manual handbook "
    "explained better almanac daily weekly tribune gazette herald post times observer church parish charity foundation "
    "institute academy college nursery clinic dental surgery vet law legal court police fire water energy solar wind"
).split()
_KNOWN = (
    "wikipedia.org wikimedia.org archive.org gutenberg.org w3.org ietf.org mozilla.org apache.org kernel.org gnu.org "
    "python.org debian.org ubuntu.com github.com gitlab.com stackoverflow.com arxiv.org nature.com sciencemag.org nasa.gov "
    "noaa.gov nih.gov loc.gov usda.gov census.gov who.int un.org europa.eu gov.uk nhs.uk parliament.uk ox.ac.uk cam.ac.uk "
    "ucl.ac.uk ed.ac.uk mit.edu stanford.edu harvard.edu yale.edu princeton.edu berkeley.edu toronto.ca ubc.ca mcgill.ca "
    "anu.edu.au unimelb.edu.au ethz.ch tum.de uni-heidelberg.de sorbonne-universite.fr lemonde.fr spiegel.de zeit.de "
    "elpais.com elmundo.es corriere.it nytimes.com washingtonpost.com latimes.com theguardian.com reuters.com apnews.com "
    "cnn.com npr.org pbs.org cbc.ca abc.net.au economist.com ft.com bloomberg.com amazon.com ebay.com ikea.com lego.com "
    "imdb.com goodreads.com allrecipes.com tripadvisor.com booking.com weather.com nationalgeographic.com britannica.com "
    "merriam-webster.com duolingo.com coursera.org khanacademy.org ted.com spotify.com youtube.com vimeo.com flickr.com "
    "wordpress.com blogger.com medium.com"
).split()
_ENDINGS = ("com", "org", "net", "info", "co.uk", "de", "fr", "ca", "io", "edu")
_PREFIXES = ("", "www.", "", "blog.", "m.")
_PATHS = ("", "/", "/about", "/index.html", "/2023/05/a-title-of-words", "/page/2", "/articles/1234", "/category/item?id=7", "/en/contact")


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The built-in labelled table (url, unwanted), some 1,500 rows made by rule from the word lists above.

    Unwanted are the unwanted words alone, in pairs, beside an ordinary word, with a number and
    in the path of an ordinary site; wanted are ordinary words alone and in pairs, and known
    sites. Prefixes, endings and paths are dealt out in turn to both, so that they tell nothing.
    A user's own table is passed to ``train`` instead.
    """
    rows: list[tuple[str, float]] = []

    def add(label: float, host: str, path: str | None = None) -> None:
        i = len(rows)
        rows.append((f"https://{_PREFIXES[i % 5]}{host}{_PATHS[i * 7 % 9] if path is None else path}", label))

    def end(name: str) -> str:
        return f"{name}.{_ENDINGS[len(rows) * 3 % 10]}"

    for i, (a, b) in enumerate(itertools.pairwise([*_UNWANTED, _UNWANTED[0]])):
        plain = _ORDINARY[i % len(_ORDINARY)]
        for name in (a, f"{a}-{b}", f"{a}{b}", f"{plain}{a}", f"{a}{plain}", f"{a}{i}"):
            add(1.0, end(name))
        add(1.0, _KNOWN[i % len(_KNOWN)], f"/{a}-{b}/{i}")
    for i, (a, b) in enumerate(itertools.pairwise([*_ORDINARY, _ORDINARY[0]])):
        far = _ORDINARY[(i * 29 + 7) % len(_ORDINARY)]
        for name in (a, f"{a}-{b}", f"{a}{far}", f"the{far}{a}", f"{a}{i}"):
            add(0.0, end(name))
    for i, host in enumerate(_KNOWN):
        add(0.0, host)
        add(0.0, host, f"/{_ORDINARY[i % len(_ORDINARY)]}/{_ORDINARY[i * 5 % len(_ORDINARY)]}-{i}")
    return spark.createDataFrame(pa.table({"url": [u for u, _ in rows], "unwanted": [x for _, x in rows]}))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; null where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(rule_path)
        name = F.when(fits, F.lit(rule_host + rule_path)).otherwise(name)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def ngrams(host: Column, path: Column) -> Column:
    """All character n-grams of host and path, with marked ends; from code points, in time linear in the url."""
    characters = F.split(F.concat(F.lit("^"), host, path, F.lit("$")), "")

    def of(held: Column, n: int) -> Column:
        first = F.slice(held, 1, F.greatest(F.size(held) - (n - 1), F.lit(0)))
        return F.transform(first, lambda c, i: F.concat(c, *[F.get(held, i + k) for k in range(1, n)]))

    # through a lambda, so that the characters are found once
    return F.flatten(F.transform(F.array(characters), lambda held: F.concat(*[of(held, n) for n in NGRAMS])))


def train(labelled: DataFrame, buckets: int = BUCKETS) -> PipelineModel:
    """Fit the filter to ``url, unwanted`` (1 unwanted, 0 wanted); rows without a label are left out.

    The share of unwanted rows is the prior: a URL without evidence is judged by it. A table of
    more than ``MOST_LABELLED`` rows is refused rather than cut.
    """
    rows = labelled.where(F.col("unwanted").isNotNull())
    n = rows.count()
    if not 0 < n <= MOST_LABELLED:
        raise ValueError(f"{n} labelled URLs; from 1 to {MOST_LABELLED} are asked for")
    grams = rows.select(ngrams(host_of(F.col("url")), path_of(F.col("url"))).alias("grams"), F.col("unwanted").cast("double"))
    return Pipeline(
        stages=[
            HashingTF(inputCol="grams", outputCol="counts", numFeatures=buckets, binary=True),
            Normalizer(inputCol="counts", outputCol="features"),
            LogisticRegression(labelCol="unwanted", regParam=REGULARISATION, standardization=False, maxIter=100),
        ]
    ).fit(grams.coalesce(1))


def judge(pages: DataFrame, model: PipelineModel, rules=RULES, threshold: float = 0.5, url_col: str = "url") -> DataFrame:
    """The input row as struct ``row``, then ``host, path, rule, verdict, unwanted`` (the model's probability).

    Defined cases: a null URL or one without ``://`` has an empty host and path and is
    judged by the model like any text; a URL of any length is judged whole; an empty
    table gives an empty result; repeated rows each get a verdict; other columns are
    carried in ``row``, whatever their names.
    """
    url = F.col("row")[url_col]
    split = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("row")).select(
        "row", host_of(url).alias("host"), path_of(url).alias("path")
    )
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    scored = model.transform(split.select("*", name.alias("rule"), verdict.alias("ruled"), ngrams(F.col("host"), F.col("path")).alias("grams")))
    unwanted = vector_to_array("probability")[1]
    return scored.select(
        "row",
        "host",
        "path",
        "rule",
        F.coalesce("ruled", F.when(unwanted >= threshold, "block").otherwise("allow")).alias("verdict"),
        unwanted.alias("unwanted"),
    )


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every url of ``pages`` under the fixed rules and the built-in labelled table."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages, train(labelled_urls(spark))).select("row.page_id", "host", "path", "rule", "verdict", "unwanted")

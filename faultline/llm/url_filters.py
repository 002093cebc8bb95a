"""URL filters by hashed host-suffix / path-prefix expressions.

Each url expands into every (host suffix, path prefix) that some rule could
name.  The expressions are equi-joined with the rules on a short prefix of
their SHA-256, a hit counts only when the whole digest is equal, and the
longest rule that fits decides.

Work per url is bounded: a suffix is taken only for label counts that occur
among the rules, a prefix only for path lengths that occur among them, so a
url of a million labels costs no more than those few expressions.

Edge cases: a null url, or one without ``://``, has an empty host and an
empty path and gets the default verdict unless a rule names the empty host;
repeated rows stay repeated; an empty table gives an empty result; without
rules every url gets the default verdict; of rules that repeat with both
verdicts, block wins; extra columns are ignored (``keep`` names those to
return).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower

#: Hex digits of the digest that the equi-join uses.
PREFIX_DIGITS = 8
#: A rule table up to this many bytes of text is broadcast; a larger one is
#: joined by a shuffle on salted prefixes.
BROADCAST_BYTES = 32 << 20
SALTS = 32


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return ascii_lower(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))).otherwise(F.lit(""))


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(F.length(host).cast("string"), F.lit(":"), host, path), 256)


def _labels(host: Column) -> Column:
    return F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1


def compile_rules(rules: DataFrame) -> DataFrame:
    """``host, path, verdict`` rows as ``prefix, digest, rule, rule_verdict, rank``.

    Rows with a null in any of the three are no rules."""
    r = (rules.select(ascii_lower(F.col("host")).alias("host"), "path", "verdict").dropna()
         .groupBy("host", "path").agg(F.max("verdict").alias("verdict")))  # block > allow
    digest = _digest(F.col("host"), F.col("path"))
    return r.select(F.left(digest, F.lit(PREFIX_DIGITS)).alias("prefix"), digest.alias("digest"),
                    F.concat("host", "path").alias("rule"), F.col("verdict").alias("rule_verdict"),
                    F.length(F.concat("host", "path")).alias("rule_length"), F.length("host").alias("host_length"))


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", keep: tuple[str, ...] = (),
               default: str = "allow", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``keep`` columns plus ``host, path, rule, verdict`` for every row of ``pages``.

    ``rules`` has ``host, path, verdict``.  A rule fits its host and all
    subdomains when the url's path starts with the rule's; the longest wins
    (equal lengths: the one with the longer host)."""
    shape = rules.select("host", "path", "verdict").dropna().agg(
        F.collect_set(_labels(F.col("host"))).alias("labels"), F.collect_set(F.length("path")).alias("lengths"),
        F.coalesce(F.sum(F.octet_length("host") + F.octet_length("path") + 150), F.lit(0)).alias("size")).first()
    compiled = compile_rules(rules)

    counts = F.array(*[F.lit(k) for k in sorted(shape["labels"])]).cast("array<int>")
    lengths = F.array(*[F.lit(n) for n in sorted(shape["lengths"])]).cast("array<int>")
    rows = pages.select(*[F.col(c) for c in keep], host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    rows = rows.select(F.struct(*rows.columns).alias("page"), F.monotonically_increasing_id().alias("row_id"))
    host, path = F.col("page.host"), F.col("page.path")
    suffixes = F.transform(F.filter(counts, lambda k: k <= _labels(host)), lambda k: F.call_function("substring_index", host, F.lit("."), -k))
    prefixes = F.transform(F.filter(lengths, lambda n: n <= F.length(path)), lambda n: F.left(path, n))
    digests = F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: _digest(h, p))))
    asked = (rows.select("row_id", "page", F.explode_outer(digests).alias("asked"))
             .withColumn("prefix", F.left("asked", F.lit(PREFIX_DIGITS))))

    if shape["size"] <= broadcast_bytes:
        found = asked.join(F.broadcast(compiled), "prefix", "left")
    else:  # a frequent expression is dealt over SALTS tasks
        salted = compiled.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        found = asked.withColumn("salt", F.pmod(F.xxhash64("row_id"), F.lit(SALTS)).cast("int")).join(
            salted, ["prefix", "salt"], "left")
    best = F.max(F.when(F.col("asked") == F.col("digest"),
                        F.struct("rule_length", "host_length", "rule", "rule_verdict"))).alias("best")
    return (found.groupBy("row_id").agg(F.first("page").alias("page"), best)
            .select("page.*", F.col("best.rule").alias("rule"),
                    F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict")))

"""Personal data by bootstrapped contextual extraction, in DataFrame functions only.

Base patterns (email, ip, card, phone) give seeds, and so do tokens in the form of a known kind of key, as secrets. Each seed's contexts
are lexical patterns: the two words before it, the one before it at a line's start, the one before with the one after, and the two after,
on its line, in lower case with digits folded. The contexts of each other identifier-like token (one with a digit or @)
are taken alike. Patterns and
instances form a bipartite graph, summed over the whole corpus before it is scored. In each round a pattern's score
for a kind is the mean score of its distinct instances, and an instance's is the noisy-or of its patterns' scores;
seeds keep score one. Patterns that enough known instances support, and whose score is high, then give the spans
of unseen identifiers in their context, if these look at all like the kind (LIKE).

Base matches are the leftmost non-overlapping ones. The regular expressions are possessive and start only at a run's start or where
the last match ended, which gives the same matches and keeps long runs linear. Contexts come from the gaps between matches and the
match before, so a very long text costs in proportion to its length.

Defined cases: a null or empty text has no spans; repeated rows have the same spans each and count once more as support only
if their text differs in the instance; ties among spans are ordered by kind, start and end; a token that two kinds' patterns accept has
a span of each; a very long text is read whole; an empty table gives an empty result. Columns with other names are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stash, table, text_of

KINDS = ("email", "ip", "card", "phone")
#: The place after the kinds: found by context only, reported apart.
SECRETS = len(KINDS)
PATTERNS = (
    r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"[0-9](?:[\x20-]?[0-9])++",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)
#: An identifier-like token: a run without white space that has a digit or @.
TOKEN = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
#: Known forms of keys (fixed values): seeds of secrets.
SECRET = r"^(?:[0-9a-f]{32,}|(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36}|sk-[0-9A-Za-z]{20,})$"
#: What an unseen instance of a kind has to look like at least.
LIKE = (r"@|.\..", r"[.:]", r"(?:[0-9][^0-9]*){8}", r"(?:[0-9][^0-9]*){5}", r".{8}")
#: Words beside a token on its line: before it, at the line's start before it, and after it.
W, B = r"[^\x20\x09-\x0D]+", r"[\x20\x09]"
BEFORE, AT_START, AFTER = rf"(?:({W}){B}+)?({W}){B}*$", rf"\n{B}*({W}){B}*$", rf"^{W}?{B}+({W})(?:{B}+({W}))?"
#: Pieces between spaces that a side keeps, so that it holds two words whatever the white space between.
SIDE = 8
#: Known instances that a pattern needs, its least score, an instance's least score, and rounds of scoring.
SUPPORT, PATTERN_SCORE, INSTANCE_SCORE, ROUNDS = 5, 0.8, 0.8, 3
BLOCK = 128
P = "__p_"


def _matches(d: DataFrame, patterns: dict[str, tuple[str, Column]]) -> DataFrame:
    """d with __p_<name>: array<struct<s,e,v,left,right>> of each pattern's matches in text, empty unless wanted. A match starts
    where the lengths in code points of all that is before it end; these sums go by blocks of BLOCK matches, so that a
    text with many thousand matches does not cost their square. Each step is a column, so that none is computed twice."""
    c = lambda step, k: F.col(f"{P}{step}_{k}")
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)
    cut = lambda k, b, n=F.lit(BLOCK): F.slice(c("lens", k), b * BLOCK + 1, n)
    blocks = lambda k: F.sequence(F.lit(0), F.floor((F.size(c("lens", k)) - 1) / BLOCK).cast("int"))
    none = F.expr("cast(array() as array<struct<s:int,e:int,v:string,left:string,right:string>>)")
    some = {k: F.size(c("found", k)) > 0 for k in patterns}
    d = d.withColumns({f"{P}found_{k}": F.when(wanted, F.regexp_extract_all("text", F.lit(p), F.lit(0))) for k, (p, wanted) in patterns.items()})
    d = d.withColumns({f"{P}pieces_{k}": F.when(some[k], F.split("text", p, -1)) for k, (p, _) in patterns.items()})
    d = d.withColumns({f"{P}lens_{k}": F.zip_with(F.slice(c("pieces", k), F.lit(1), F.size(c("found", k))), c("found", k), lambda g, v: F.length(g) + F.length(v)) for k in patterns})
    d = d.withColumns({f"{P}sums_{k}": F.transform(blocks(k), (lambda k: lambda b: total(cut(k, b)))(k)) for k in patterns})
    d = d.withColumns({f"{P}ends_{k}": F.flatten(F.transform(blocks(k), (lambda k: lambda b: F.transform(cut(k, b), lambda _, j: total(cut(k, b, j + 1)) + total(F.slice(c("sums", k), F.lit(1), b))))(k))) for k in patterns})
    d = d.withColumns({f"{P}spans_{k}": F.zip_with(c("ends", k), c("found", k), lambda e, v: F.struct((e - F.length(v)).alias("s"), e.alias("e"), v.alias("v"))) for k in patterns})
    gap = lambda k, i: F.get(c("pieces", k), i)
    left = lambda k, i: F.substring_index(F.concat(F.when(i == 0, "\n").otherwise(F.concat(gap(k, i - 1), F.get(c("found", k), i - 1))), gap(k, i)), " ", -SIDE)
    right = lambda k, i: F.substring_index(F.concat(gap(k, i + 1), F.coalesce(F.get(c("found", k), i + 1), F.lit(""))), " ", SIDE)
    d = d.withColumns({f"{P}{k}": F.coalesce(F.transform(c("spans", k), (lambda k: lambda x, i: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["v"].alias("v"), left(k, i).alias("left"), right(k, i).alias("right")))(k)), none) for k in patterns})
    return d.drop(*(f"{P}{step}_{k}" for k in patterns for step in ("found", "pieces", "lens", "sums", "ends", "spans")))


def _luhn(digits: Column) -> Column:
    n = F.length(digits)
    # from the right, every second digit counts double, less 9 if over 9
    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda s, i: s + (lambda d: F.when(((n - i) % 2) == 1, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d))(F.substring(digits, i, F.lit(1)).cast("int"))) % 10 == 0


def _valid(kind: str, v: Column) -> Column:
    if kind == "ip":
        return ~F.exists(F.split(v, r"\."), lambda x: ~x.rlike(r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})$"))
    digits = F.regexp_replace(v, "[^0-9]", "")
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(False)
    return F.length(digits).between(9, 15) if kind == "phone" else F.lit(True)


def base_spans(docs: DataFrame) -> DataFrame:
    """doc_id, and __p_base: array<struct<kind:int,s,e,v,left,right>> in order of kind and start, and __p_other: the identifier-like tokens."""
    t = text_of()
    d = docs.select(F.col("doc_id"), t.alias("text"))
    t = F.col("text")
    d = d.withColumn(f"{P}digit", t.rlike("[0-9]")).withColumn(f"{P}at", F.contains(t, F.lit("@")))
    digit, at = F.col(f"{P}digit"), F.col(f"{P}at")
    wanted = {"email": at, "ip": digit, "card": digit, "phone": digit & F.contains(t, F.lit("+")), "token": digit | at}
    d = _matches(d, {k: (p, wanted[k]) for k, p in zip((*KINDS, "token"), (*PATTERNS, TOKEN))})
    kinds = [F.transform(F.filter(f"{P}{k}", (lambda k: lambda x: _valid(k, x["v"]))(k)), (lambda i: lambda x: F.struct(F.lit(i).alias("kind"), x["s"].alias("s"), x["e"].alias("e"), x["v"].alias("v"), x["left"].alias("left"), x["right"].alias("right")))(i)) for i, k in enumerate(KINDS)]
    d = d.withColumn(f"{P}base", F.concat(*kinds))
    # a token without the punctuation around it
    def core(x: Column) -> Column:
        lead = F.length(F.regexp_extract(x["v"], r"^[^\p{L}\p{N}+@]*+", 0))
        body = F.regexp_extract(x["v"], r"^[^\p{L}\p{N}+@]*+(.*[\p{L}\p{N}])", 1)
        return F.struct((x["s"] + lead).alias("s"), (x["s"] + lead + F.length(body)).alias("e"), body.alias("v"), x["left"].alias("left"), x["right"].alias("right"))
    base = F.col(f"{P}base")
    tokens = F.filter(F.transform(f"{P}token", core), lambda x: (F.length(x["v"]) > 0) & ~F.exists(base, lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"])))
    return d.withColumn(f"{P}other", tokens).select("doc_id", f"{P}base", f"{P}other")


def _contexts(x: Column) -> Column:
    """The patterns that a token's sides give."""
    left, right = x["left"], x["right"]
    part = lambda side, pattern, k: F.nullif(F.regexp_extract(side, pattern, k), F.lit(""))
    one, two = part(left, BEFORE, 2), part(left, BEFORE, 1)
    after, last = part(right, AFTER, 1), part(right, AFTER, 2)
    made = F.array(F.concat(two, F.lit(" "), one, F.lit(" _")), F.concat(F.lit("^ "), part(left, AT_START, 1), F.lit(" _")), F.concat(one, F.lit(" _ "), after), F.concat(F.lit("_ "), after, F.lit(" "), last))
    return F.transform(F.array_compact(made), lambda c: F.regexp_replace(F.lower(c), "[0-9]+", "0"))


def bootstrap(occurrences: DataFrame) -> DataFrame:
    """(ctx, inst, kind): the accepted pairs. occurrences: ctx, inst, kind (null if not a seed)."""
    seen = occurrences.filter("ctx is not null")
    edges = stash(seen.groupBy("ctx", "inst").agg(F.max("kind").alias("seed")), "edges")
    seeds = edges.filter("seed is not null").select("inst", F.col("seed").alias("kind"), F.lit(1.0).alias("score")).distinct()
    sizes = edges.groupBy("ctx").agg(F.count("*").alias("n"))
    scores = seeds
    for k in range(ROUNDS):
        known = edges.select("ctx", "inst").join(scores, "inst")
        patterns = known.groupBy("ctx", "kind").agg(F.sum("score").alias("sum"), F.count_if(F.col("score") >= INSTANCE_SCORE).alias("support"))
        patterns = patterns.filter(F.col("support") >= SUPPORT).join(sizes, "ctx").withColumn("conf", F.col("sum") / F.col("n"))
        patterns = stash(patterns.filter(F.col("conf") >= (PATTERN_SCORE if k == ROUNDS - 1 else PATTERN_SCORE / 2)).select("ctx", "kind", "conf"), "patterns")
        scored = edges.select("ctx", "inst").join(patterns, "ctx").groupBy("inst", "kind").agg((1 - F.exp(F.sum(F.log(F.greatest(F.lit(1e-9), 1 - F.col("conf")))))).alias("score"))
        scores = stash(seeds.unionByName(scored.join(seeds.select("inst", "kind"), ["inst", "kind"], "left_anti")), "scores")
    like = F.coalesce(*(F.when(F.col("kind") == i, F.col("inst").rlike(x)) for i, x in enumerate(LIKE)))
    good = scores.filter((F.col("score") >= INSTANCE_SCORE) & like)
    return edges.filter("seed is null").select("ctx", "inst").join(patterns, "ctx").join(good.select("inst", "kind"), ["inst", "kind"], "left_semi").select("ctx", "inst", "kind")


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, base and extra: arrays of (kind, s, e), kind as a place in KINDS or SECRETS, for each row of docs."""
    as_found = lambda x, kind: F.struct(kind.alias("kind"), x["s"].alias("s"), x["e"].alias("e"), x["v"].alias("inst"), _contexts(x).alias("ctx"))
    secret = lambda x: F.when(x["v"].rlike(SECRET), SECRETS).cast("int")
    found = base_spans(docs).withColumns({
        f"{P}base": F.transform(f"{P}base", lambda x: as_found(x, x["kind"])),
        f"{P}other": F.transform(f"{P}other", lambda x: as_found(x, secret(x))),
    })
    rows = stash(found.withColumn(f"{P}row", F.monotonically_increasing_id()), "pii")
    each = rows.select(f"{P}row", F.explode(F.concat(f"{P}base", f"{P}other")).alias("x")).select(f"{P}row", "x.kind", "x.s", "x.e", "x.inst", F.explode("x.ctx").alias("ctx"))
    pairs = bootstrap(each)
    extra = each.filter("kind is null").drop("kind").join(pairs, ["ctx", "inst"]).groupBy(f"{P}row").agg(F.collect_set(F.struct("kind", "s", "e")).alias("extra"))
    none = F.expr("cast(array() as array<struct<kind:int,s:int,e:int>>)")
    plain = lambda c: F.transform(c, lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e")))
    seeds = plain(F.filter(f"{P}other", lambda x: x["kind"].isNotNull()))
    return rows.join(extra, f"{P}row", "left").select("doc_id", plain(f"{P}base").alias("base"), F.concat(F.coalesce("extra", none), seeds).alias("extra"))


def _joined(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in (*KINDS, "secret")))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def op1_pii(spark, sf_dir):
    """The columns of the contract, then secrets apart (n_secret, secret_spans) and n_spans, the number of all spans."""
    d = find_pii(table(spark, sf_dir, "documents"))
    count = lambda i: F.size(F.filter("base", lambda x: x["kind"] == i)).cast("long")
    secrets = F.sort_array(F.filter("extra", lambda x: x["kind"] == SECRETS))
    personal = F.sort_array(F.concat("base", F.filter("extra", lambda x: x["kind"] < SECRETS)))
    return d.select("doc_id", *(count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(personal).alias("spans"),
                    F.size(secrets).cast("long").alias("n_secret"), _joined(secrets).alias("secret_spans"), (F.size("base") + F.size("extra")).cast("long").alias("n_spans"))

"""Personal data, in DataFrame operations only: base patterns and bootstrapped contextual extraction.

Base: email, ip, card and phone by their patterns, leftmost and non-overlapping for each kind; matches
that fail their kind's test (parts up to 255, length and Luhn sum, number of digits) are dropped.
Positions are code points, end exclusive.

Contextual: instances are base matches, whole, and the tokens between white space with a digit or @,
without a name and = or : before them and marks around them. Seeds are the base matches and, as a kind
of their own (`secret`), assigned random values whose hash is even: at least 16 letters, digits and
+/_.~- in which digits and letters take turns three times, after a name and = or :. The other half of
such values are no seeds; only what the seeds' contexts teach finds them.

An instance has up to three lexical patterns: the word before it (or before the run of instances that it
stands in), that word with the = or : between them, and the two words before it. Over the graph of
patterns and instances Spark scores in ROUNDS turns. A pattern's confidence is the mean confidence of
what follows it, taken over its distinct instances and over all tokens of the corpus that follow it,
ordinary words too, whichever is less; so "the" never becomes a pattern. Seeds are certain. An unseen
instance of at least LENGTH characters is, for a pattern, as likely as its uses after other words: the
mean over them of the confidence of seeded patterns that reach CONFIDENT, none for others; all else
counts as none. An unseen instance that stands after this word alone, and has the shape of one of the
pattern's seeds (the same classes of characters, and a length of the same power of two), speaks neither
for the pattern nor against it, up to VOUCHED such instances for each seed. All are shares, so a table of
the same make decides alike at any size, and a pattern needs nine different seeds for each instance of
another shape that nothing else speaks for. Seeded patterns that reach CONFIDENT then discover the
identifiers before which they stand elsewhere: tokens of at least LENGTH characters that no base match
covers get a span of the kind of the pattern's seeds, named `like_<kind>`. Seeds that are secrets, and
what was discovered in the shape of one, get their spans wherever they occur. Base spans always stay.

Null and empty texts have no spans. The context of an instance is looked up in the whole text before it,
however long. Patterns are written so that a text's length costs in proportion, with neither backtracking
over a run nor recursion; a document's words must fit a task. Rows are told apart by (doc_id, hash of
text), with null ids equal; rows that repeat both get the same result. Of patterns that discover one token
the surer speaks, ties go to the pattern that sorts last. Tables without rows give none. Other columns are
not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackwright.llm.common import stage

KINDS = ["email", "ip", "card", "phone"]
#: The contract's patterns. \\G or a look-behind lets a match start only where a run starts or the last
#: match ended, which changes no match; possessive repeats stand where giving back can't help.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++",
    "ip": r"(?=[0-9])(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
NEEDS = {"email": "@", "ip": ".", "phone": "+"}
#: Every base match starts in the token at the end of such a piece; pieces follow each other without gaps.
PIECE = r"\G[^0-9@]*+[0-9@]\S*+"
BLANKS = " \t\n\x0b\f\r"
#: The last token with a letter, the one right before it, and what follows it: marks and white space.
CONTEXT = r"(?<!\S)(?:(\S++)\s++)?(\S*\p{L}\S*+)(\s[^\p{L}]*+)?\z"
#: Holds if CONTEXT finds in the last NEAR characters what it would find in all.
ENOUGH, NEAR = r"\s\S++\s++\S*\p{L}\S*+(?:\s[^\p{L}]*+)?\z", 120
#: A name in an instance's token and its = or :; marks around words.
NAMED = r"^([\p{L}_]++)([=:]++)"
MARKS = "!\"#$%&'()*+,-./:;<=>?[\\]^_`{|}~«»“”‘’„…–—¿¡"
#: Between words; a word with the = or : after it, unless that and an instance are one token; a name that
#: is assigned something else in its token.
BETWEEN = r"[\p{P}\p{S}]*+\s[\s\p{P}\p{S}]*+"
SIGNED = r"\p{L}[\p{L}_]*+[^\p{L}\p{N}@\s=:]*+(?:[=:]++(?!\S*[0-9@])|\s[^\p{L}\p{N}@=:]*+[=:]++)"
ASSIGNS = r"(?<!\S)[^\p{L}\s]*+\p{L}[\p{L}_]*+[=:]++(?=[^\s0-9@]*\p{L}[^\s0-9@]*+(?!\S))"
#: Values that look random: allowed characters, and digits and letters taking turns.
VALUE, TURNS = r"^[0-9A-Za-z+/_.~-]{16,}={0,2}$", r"^[A-Za-z]*+(?:[^0-9A-Za-z]*+[0-9]++[^0-9A-Za-z]*+[A-Za-z]++){3}"
SECRET = "secret"
CONTEXT_TYPE = "struct<prev:string,word:string,rest:string>"
CONFIDENT, LENGTH, ROUNDS, VOUCHED = 0.9, 8, 3, 3
#: Most patterns that are broadcast to where words are counted (strings of some 10 bytes); more are shuffled.
BROADCAST_PATTERNS = 500_000
#: Matches whose positions are summed up in one go.
RUN = 256


def matches_of(text: Column, pattern: str, needs: str | None) -> Column:
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.when(F.instr(text, needs) > 0, found).otherwise(F.array().cast("array<string>")) if needs else found


def gaps_and_hits(text: Column, matches: Column, pattern: str) -> Column:
    """Matches, each with the length of the gap before it."""
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), matches.alias("hit"))
    return F.when(F.size(matches) > 0, F.transform(pairs, lambda p: F.struct(F.length(p["gap"]).alias("gap"), p["hit"].alias("hit"), F.lit(None).cast(CONTEXT_TYPE).alias("context"))))


def tokens_in(pieces: Column) -> Column:
    """The token at the end of each piece as gaps_and_hits has matches, with the context of its gap."""

    def cut(piece):
        head = F.regexp_extract(piece, r"^[^0-9@]*+", 0)
        blanks = " " * len(BLANKS)
        near = F.translate(F.right(head, F.lit(NEAR)), BLANKS, blanks)
        text = F.when(F.instr(near, " ") > 0, near).otherwise(F.translate(head, BLANKS, blanks))
        gap = F.length(head) - F.length(F.substring_index(text, " ", -1))
        return F.struct(piece.alias("piece"), gap.alias("gap"))

    def token(x):
        return F.struct(x["gap"].alias("gap"), F.substring(x["piece"], x["gap"] + 1, F.length(x["piece"])).alias("hit"), context_of(F.left(x["piece"], x["gap"])).alias("context"))

    return F.when(F.size(pieces) > 0, F.transform(F.transform(pieces, cut), token))


def context_of(gap: Column) -> Column:
    """CONTEXT's groups in the text before a match."""
    tail = F.right(gap, F.lit(NEAR))
    text = F.when((F.length(gap) <= NEAR) | F.regexp_like(tail, F.lit(ENOUGH)), tail).otherwise(gap)
    # the array binds the text, so that it is made once
    return F.transform(F.array(text), lambda t: F.struct(*[F.regexp_extract(t, CONTEXT, k).alias(n) for k, n in ((1, "prev"), (2, "word"), (3, "rest"))]))[0]


def placed(matches: Column, zipped: str) -> Column:
    """array<start, end, value, lead, context>: the gaps between matches tell where each stands. context is
    that of the match or of the run of matches without words between them; lead: it is the run's first."""
    kind = f"array<struct<start:int,end:int,value:string,lead:boolean,context:{CONTEXT_TYPE}>>"
    empty, none = F.array().cast(kind), F.lit(None).cast(CONTEXT_TYPE)

    def step(state, pair):
        start = state["at"] + pair["gap"]
        end = start + F.length(pair["hit"])
        lead = F.coalesce(pair["context"]["word"] != "", F.lit(False))
        context = F.when(lead, pair["context"]).otherwise(state["context"])
        span = F.named_struct(F.lit("start"), start, F.lit("end"), end, F.lit("value"), pair["hit"], F.lit("lead"), lead, F.lit("context"), context)
        return F.when(pair["hit"].isNull(), state).otherwise(F.named_struct(F.lit("at"), end, F.lit("context"), context, F.lit("out"), F.array_append(state["out"], span)))

    # in runs of RUN matches, whose lengths then shift the runs after them: costs stay near linear
    def walk(run):
        return F.aggregate(run, F.struct(F.lit(0).alias("at"), none.alias("context"), empty.alias("out")), step)

    def shift(state, run):
        moved = F.transform(run["out"], lambda s: F.named_struct(F.lit("start"), s["start"] + state["at"], F.lit("end"), s["end"] + state["at"], F.lit("value"), s["value"], F.lit("lead"), s["lead"], F.lit("context"), F.coalesce(s["context"], state["context"])))
        return F.named_struct(F.lit("at"), state["at"] + run["at"], F.lit("context"), F.coalesce(run["context"], state["context"]), F.lit("out"), F.array_append(state["out"], moved))

    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(matches) - 1) / RUN).cast("int")), lambda i: i * RUN + 1)
    several = F.aggregate(F.transform(runs, lambda i: walk(F.slice(F.col(zipped), i, F.lit(RUN)))), F.struct(F.lit(0).alias("at"), none.alias("context"), F.array().cast(f"array<{kind}>").alias("out")), shift, lambda s: F.flatten(s["out"]))
    return F.when(F.size(matches) == 0, empty).otherwise(several)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Every second digit from the right is doubled, less 9 if above 9."""
    each = F.split(F.reverse(digits), "")
    return F.aggregate(
        F.transform(each, lambda d, i: F.when(i % 2 == 0, F.try_to_number(d, F.lit("9")).cast("int")).otherwise(F.element_at(F.array(*map(F.lit, [0, 2, 4, 6, 8, 1, 3, 5, 7, 9])), F.try_to_number(d, F.lit("9")).cast("int") + 1))),
        F.lit(0),
        lambda s, d: s + F.coalesce(d, F.lit(0)),
    ) % 10 == 0


def _passes(kind: str):
    def test(span):
        value = span["value"]
        if kind == "ip":
            return F.forall(F.split(value, r"\."), lambda p: F.regexp_like(p, F.lit("^0*([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$")))
        digits = _digits(value)
        if kind == "card":
            return F.length(digits).between(12, 19) & _luhn(F.substring(digits, 1, 19))
        if kind == "phone":
            return F.length(digits).between(9, 15)
        return F.lit(True)

    return test


def find_base(docs: DataFrame) -> DataFrame:
    """(doc_id, key, email, ip, card, phone, tokens): arrays of spans. Narrow: texts go no further."""
    df = docs.select(F.col("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    df = df.withColumns({f"m_{k}": matches_of(F.col("text"), PATTERNS[k], NEEDS.get(k)) for k in KINDS} | {"m_tokens": matches_of(F.col("text"), PIECE, None)})
    df = df.withColumns({f"z_{k}": gaps_and_hits(F.col("text"), F.col(f"m_{k}"), p) for k, p in PATTERNS.items()} | {"z_tokens": tokens_in(F.col("m_tokens"))})
    arrays = {k: F.filter(placed(F.col(f"m_{k}"), f"z_{k}"), _passes(k)) for k in KINDS}
    return df.select("doc_id", F.xxhash64("text").alias("key"), *[v.alias(k) for k, v in arrays.items()], placed(F.col("m_tokens"), "z_tokens").alias("tokens"))


def all_spans() -> Column:
    """The spans of all kinds in one array; rank puts kinds in the order in which they are listed."""

    def tagged(rank: int):
        return lambda s: F.named_struct(F.lit("start"), s["start"], F.lit("rank"), F.lit(rank), F.lit("kind"), F.lit(KINDS[rank]), F.lit("end"), s["end"])

    return F.concat(*[F.transform(F.col(k), tagged(i)) for i, k in enumerate(KINDS)])


def word_of(token: Column) -> Column:
    """A token without marks and blanks around it."""
    return F.lower(F.btrim(token, F.lit(MARKS + BLANKS)))


def sign_of(marks: Column) -> Column:
    return F.when(F.instr(marks, "=") > 0, "=").when(F.instr(marks, ":") > 0, ":").otherwise("")


def patterns_of(word: Column, sign: Column, prev: Column) -> Column:
    return F.array_compact(F.array(word, F.when(sign != "", F.concat(word, sign)), F.when(prev != "", F.concat_ws(" ", prev, word))))


def candidates(base: DataFrame) -> DataFrame:
    """(doc_id, key, start, end, word, sign, prev, lead, instance, kind, shape): seeds with their kind, and tokens
    that none covers without, each with the words and the sign before it."""

    def seed(kind: str):
        return lambda s: F.named_struct(F.lit("start"), s["start"], F.lit("end"), s["end"], F.lit("instance"), s["value"], F.lit("kind"), F.lit(kind))

    seeds = F.concat(*[F.transform(F.col(k), seed(k)) for k in KINDS])
    t = base.select("doc_id", "key", seeds.alias("seeds"), F.explode("tokens").alias("t"))
    t = t.withColumns({"name": F.regexp_extract("t.value", NAMED, 1), "signs": F.regexp_extract("t.value", NAMED, 2)})
    rest = F.substring(F.col("t.value"), F.length("name") + F.length("signs") + 1, F.length("t.value"))
    t = t.withColumns({"marks": F.length(F.regexp_extract(rest, r"^[^\p{L}\p{N}]*+", 0)), "core": F.regexp_replace(F.regexp_replace(rest, r"^[^\p{L}\p{N}]++", ""), r"(?<![^\p{L}\p{N}])[^\p{L}\p{N}]++\z", "")})
    begin, before = F.col("t.start") + F.length("name") + F.length("signs") + F.col("marks"), F.col("t.context")
    named = F.col("name") != ""
    own, outer = word_of(F.col("name")), word_of(before["word"])
    t = t.withColumns({
        "begin": begin, "word": F.when(named, own).otherwise(outer), "lead": F.col("t.lead") & ~named,
        "sign": F.coalesce(F.when(named, sign_of(F.col("signs"))).when(F.col("t.lead"), sign_of(F.concat(F.regexp_extract(before["word"], r"[^\p{L}]*+\z", 0), before["rest"], F.substring(F.col("t.value"), F.lit(1), F.col("marks"))))), F.lit("")),
        "prev": F.coalesce(F.when(~F.col("t.lead"), "").when(~named, word_of(before["prev"])).when(F.btrim(before["rest"], F.lit(BLANKS)) == "", outer), F.lit("")),
    }).where("word is not null and word != ''")
    t = t.withColumn("over", F.filter("seeds", lambda s: (s["start"] < F.col("t.end")) & (s["end"] > F.col("t.start"))))
    secret = (F.col("sign") != "") & F.regexp_like("core", F.lit(VALUE)) & F.regexp_like("core", F.lit(TURNS)) & (F.pmod(F.xxhash64("core"), F.lit(2)) == 0)
    token = F.array(F.struct(F.col("begin").alias("start"), (F.col("begin") + F.length("core")).alias("end"), F.col("core").alias("instance"), F.when(secret, SECRET).alias("kind")))
    # each base match once, by the token that it starts in
    base_rows = F.filter("over", lambda s: s["start"] >= F.col("t.start"))
    rows = F.when(F.size("over") == 0, token).when(secret, F.concat(base_rows, token)).otherwise(base_rows)
    t = t.select("doc_id", "key", "word", "sign", "prev", "lead", F.explode(rows).alias("r"))
    return t.select("doc_id", "key", "r.start", "r.end", "word", "sign", "prev", "lead", "r.instance", "r.kind", shape_of(F.col("r.instance")).alias("shape"))


def shape_of(instance: Column) -> Column:
    """The classes of characters of an instance, and the power of two below its length."""
    classes = [F.when(F.regexp_like(instance, F.lit(c)), n).otherwise("") for c, n in (("[0-9]", "9"), ("[a-z]", "a"), ("[A-Z]", "A"), ("@", "@"), ("[^0-9A-Za-z@]", "-"))]
    return F.concat(*classes, F.floor(F.log2(F.length(instance))).cast("string"))


def small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_PATTERNS else df


def occurrences(docs: DataFrame, able: DataFrame) -> DataFrame:
    """(pattern, seen): how often each of the patterns (word, pattern) stands in all texts, whatever follows.
    Names in instances' tokens are left out."""
    text = F.lower(F.coalesce(docs["text"], F.lit("")))
    words = F.split(text, BETWEEN)
    pairs = docs.select(F.explode(F.arrays_zip(F.concat(F.array(F.lit("")), words).alias("prev"), words.alias("word"))).alias("t")).select("t.*")
    pairs = pairs.join(small(able.select("word").distinct()), "word", "left_semi")
    plain = pairs.select(F.explode(patterns_of(F.col("word"), F.lit(""), word_of(F.col("prev")))).alias("pattern"))
    found = F.concat(
        F.transform(F.regexp_extract_all(text, F.lit(SIGNED), F.lit(0)), lambda m: F.concat(word_of(m), sign_of(m))),
        F.transform(F.regexp_extract_all(text, F.lit(ASSIGNS), F.lit(0)), word_of),
    )
    signed = docs.where((F.instr("text", "=") > 0) | (F.instr("text", ":") > 0)).select(F.explode(found).alias("pattern"))
    return plain.unionByName(signed).join(small(able.select("pattern")), "pattern", "left_semi").groupBy("pattern").agg(F.count(F.lit(1)).alias("seen"))


def learn_patterns(found: DataFrame, docs: DataFrame) -> DataFrame:
    """(pattern, score, kind) of the patterns that are trusted."""
    context = ["word", "sign", "prev"]
    edges = found.groupBy(*context, "instance").agg(F.max("kind").alias("kind"), F.first("shape").alias("shape"), F.count(F.lit(1)).alias("n"), F.count_if(~F.col("lead")).alias("free"))
    edges = stage(edges, "pii-edges")
    uses = edges.groupBy("instance").agg(F.sum("n").alias("uses"), (F.count("kind") > 0).alias("seed"), (F.min("word") == F.max("word")).alias("one_word"))
    edges = edges.join(uses, "instance").withColumn("open", ~F.col("seed") & (F.length("instance") >= LENGTH))
    edges = stage(edges, "pii-graph")
    long = edges.withColumn("pattern", F.explode(patterns_of(*map(F.col, context))))
    # only seeded patterns with an unseen instance can discover one or speak for one; shapes of their seeds are few
    able = long.groupBy("word", "pattern").agg(F.max("seed").alias("seeded"), F.max("open").alias("any"), F.collect_set(F.when(F.col("seed"), F.col("shape"))).alias("shapes")).where("seeded and any")
    able = stage(able.select("word", "pattern", "shapes"), "pii-able")
    long = long.join(able, ["word", "pattern"]).withColumn("neutral", F.col("open") & F.col("one_word") & F.array_contains("shapes", F.col("shape")))
    long = stage(long.drop("shapes", "shape"), "pii-patterns")
    # what does not change between rounds, once for each pattern: how much its confidence is a share of
    one = long.groupBy("pattern", "instance").agg(F.first("neutral").alias("neutral"), F.first("seed").alias("seed"), F.sum("n").alias("n"), F.sum("free").alias("free"))
    counts = {"all": F.lit(1), "uses": F.col("n")}
    whole = one.groupBy("pattern").agg(F.sum("free").alias("free"), *[F.sum(c).alias(k) for k, c in counts.items()], *[F.sum(F.when(F.col(by), c).otherwise(0)).alias(f"{by}_{k}") for k, c in counts.items() for by in ("neutral", "seed")])
    vouched = {k: F.least(F.col(f"neutral_{k}"), VOUCHED * F.col(f"seed_{k}")) for k in counts}
    every = F.greatest(F.col("uses"), F.col("free") + F.coalesce("seen", F.lit(0)))
    shares = stage(whole.join(occurrences(docs, able.drop("shapes")), "pattern", "left").select("pattern", (F.col("all") - vouched["all"]).alias("of_all"), (every - vouched["uses"]).alias("of_uses")), "pii-shares")
    rated = long.withColumn("confidence", F.col("seed").cast("double"))
    for turn in range(ROUNDS):
        one = rated.groupBy("pattern", "instance").agg(F.first("confidence").alias("confidence"), F.sum("n").alias("n"))
        sums = one.groupBy("pattern").agg(F.sum("confidence").alias("sure_all"), F.sum(F.col("n") * F.col("confidence")).alias("sure_uses")).join(shares, "pattern")
        score = F.least(F.col("sure_all") / F.col("of_all"), F.col("sure_uses") / F.col("of_uses"))
        trusted = stage(sums.select("pattern", score.alias("score")).where(F.col("score") >= CONFIDENT), f"pii-trusted-{turn}")
        # what trusted patterns say of an instance, once for each of its uses, and the share of uses after each word
        best = long.where("open").join(trusted, "pattern").groupBy(*context, "instance").agg((F.max("score") * F.first("n")).alias("said"))
        by_word = edges.where("open").join(best, [*context, "instance"], "left").groupBy("instance", "word").agg(F.sum("n").alias("own"), F.sum(F.coalesce("said", F.lit(0.0))).alias("own_said"), F.first("uses").alias("uses"))
        whole = by_word.groupBy("instance").agg(F.sum("own_said").alias("said"))
        rest = by_word.join(whole, "instance").select("instance", "word", F.when(F.col("uses") > F.col("own"), (F.col("said") - F.col("own_said")) / (F.col("uses") - F.col("own"))).otherwise(0.0).alias("rest"))
        rated = long.join(rest, ["instance", "word"], "left").withColumn("confidence", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("rest", F.lit(0.0))))
    kinds = long.where("kind is not null").groupBy("pattern", "kind").count().groupBy("pattern").agg(F.max_by("kind", F.struct("count", "kind")).alias("kind"))
    return trusted.join(kinds, "pattern")


def _listed(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, email, ip, card, phone, base, spans): arrays of base spans of each kind, and the lists
    of base spans and of all spans as kind:start:end."""
    base = stage(find_base(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))), "pii-base")
    found = stage(candidates(base), "pii-candidates")
    trusted = learn_patterns(found, docs)
    unseen = found.where(F.col("kind").isNull() & (F.length("instance") >= LENGTH)).drop("kind")
    seeds = found.where(F.col("kind") == SECRET)
    secrets = seeds.select("instance").distinct()
    place = ["doc_id", "key", "start", "end"]
    known = found.where(F.coalesce(F.col("kind") == SECRET, F.lit(True))).join(secrets, "instance", "left_semi").select(*place, F.lit(len(KINDS)).alias("rank"), F.lit(SECRET).alias("kind"))
    unseen = unseen.join(secrets, "instance", "left_anti")
    like = unseen.withColumn("pattern", F.explode(patterns_of(F.col("word"), F.col("sign"), F.col("prev")))).join(trusted, "pattern")
    like = stage(like.groupBy(*place).agg(F.max_by("kind", F.struct("score", "pattern")).alias("kind"), F.first("instance").alias("instance"), F.first("shape").alias("shape")), "pii-like")
    # what was discovered as a secret, in the shape of a seed, is one wherever it stands
    shaped = like.where(F.col("kind") == SECRET).join(seeds.select("shape").distinct(), "shape", "left_semi").select("instance").distinct()
    again = unseen.join(shaped, "instance", "left_semi").select(*place, F.lit(SECRET).alias("again"))
    like = like.select(*place, "kind").unionByName(again.withColumnRenamed("again", "kind")).groupBy(*place).agg(F.max("kind").alias("kind"))
    # numbered kinds sort as they are listed: base kinds, secrets, then what was discovered
    number = F.array_position(F.array(*map(F.lit, [*KINDS, SECRET])), F.col("kind")).cast("int") + len(KINDS)
    extra = known.unionByName(like.select(*place, number.alias("rank"), F.concat(F.lit("like_"), F.col("kind")).alias("kind")))
    extra = extra.groupBy("doc_id", "key").agg(F.collect_set(F.struct("start", "rank", "kind", "end")).alias("more"))
    rows = base.select("doc_id", "key", *KINDS, all_spans().alias("own")).alias("b").join(extra.alias("x"), F.col("b.doc_id").eqNullSafe(F.col("x.doc_id")) & (F.col("b.key") == F.col("x.key")), "left")
    every = F.when(F.col("more").isNull(), F.col("own")).otherwise(F.concat("own", "more"))
    return rows.select("b.doc_id", *KINDS, _listed(F.col("own")).alias("base"), _listed(every).alias("spans"))

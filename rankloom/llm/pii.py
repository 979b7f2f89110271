"""Personal data by bootstrapped contextual extraction (operator 9). DataFrame functions only.

Fixed patterns find the seeds: e-mail addresses, IP addresses, card numbers and phone numbers. The words to the left of a
seed are a lexical pattern. Other tokens that look like an identifier are candidates and have such patterns too; each has
the kinds that its characters allow (`likely`): a token of four digits is no phone number, whatever stands before it.

Patterns and instances are a graph, and rounds alternate on it until no confidence moves by a millionth. A
pattern's confidence for a kind is the sum of its instances' beliefs, over their number and one more that counts as 0. Seeds
count 1 for their kind and 0 for others, candidates of another kind 0; candidates that might be of the kind are left out
until they are judged, and then have the confidence of their best pattern. A pattern with SUPPORT different instances of
belief CONFIDENCE or more, and that confidence itself, is trusted: candidates after it are marked with its kind. They then
support other patterns as seeds do, so a cue that no seed follows can be reached by way of what is discovered.

A pattern is the two words before an identifier, or the last one alone if it ends in a colon or equals sign, within LEFT code
points; a word that begins further to the left is not read. Candidates are made of parts of at most 64 characters (local
part), 63 (label of a domain) and 41 (group of digits), the first two being what the mail and name systems allow.

Patterns and instances are counted over all documents, by group and with partial sums; nothing but two numbers a round goes to the driver.

Null text counts as empty. Repeated rows have the same spans. Empty tables give empty results. Positions are code points.
Texts of any length are read without recursion and in pieces: places are summed up by blocks of matches, and contexts are
cut from parts of PART code points. U+E000 to U+E003 serve as marks, and where a text holds these itself they are read as
U+FFFD, which none of the patterns can match. `detect` reads doc_id and text only; `redacted` keeps all columns.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import written

KINDS = ("email", "ip", "card", "phone")
CONFIDENCE = 0.8
SUPPORT = 4
LEFT = 200
PART = 4096
MATCHES = 256
JOIN, DOT, OPEN, CLOSE = "\ue000", "\ue001", "\ue002", "\ue003"
SPAN = "array<struct<s:int,e:int,m:string>>"
MENTION = "array<struct<kind:string,s:int,e:int,v:string,w:array<string>>>"

# A local part may start only where its run of characters does, or where the last match ended: the leftmost match does so in any case.
EMAIL = rf"(?:(?<![A-Za-z0-9._%+\-{DOT}])|\G)[A-Za-z0-9._%+\-{DOT}]++@[A-Za-z0-9-]++{DOT}[A-Za-z0-9\-{DOT}]++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = rf"[0-9][0-9{JOIN}]*+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
CANDIDATE = r"(?<![A-Za-z0-9@._%+=-])(?:[A-Za-z0-9._%+-]{2,64}(?: ?[\[(]at[\])] ?| at )[A-Za-z0-9-]{2,63}(?: ?[\[(]dot[\])] ?| dot |\.)[A-Za-z0-9-]{2,63}|[(]?[0-9][0-9().-]{1,40}[ ][(]?[0-9][0-9().-]{1,40}(?:[ ][(]?[0-9][0-9().-]{1,40})?|[A-Za-z0-9@._%+-]{0,64}[0-9@][A-Za-z0-9@._%+-]{0,64})"


def pieces(text: Column, pattern: str) -> Column:
    """What lies before the first match, then for each match: the match, CLOSE, what follows it."""
    return F.split(F.regexp_replace(text, pattern, f"{OPEN}$0{CLOSE}"), OPEN)


def bound(value: Column, use) -> Column:
    """use(value), with the value computed once however often `use` reads it."""
    return F.transform(F.array(value), use)[0]


def blocks(n: Column, size: int) -> Column:
    """0, 1, ... for each block of `size` of n things."""
    return F.when(n > 0, F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int"))).otherwise(F.array().cast("array<int>"))


def spans(cut: Column) -> Column:
    """Start, end and text of the matches, from `pieces`. Blocks of MATCHES get their places one by one, and begin where sums of lengths say."""
    items = F.transform(F.slice(cut, 2, F.greatest(F.size(cut), F.lit(1))), lambda x: F.struct(F.substring_index(x, CLOSE, 1).alias("m"), (F.char_length(x) - 1).alias("n")))

    def step(acc: Column, x: Column) -> Column:
        one = F.struct(acc["at"].alias("s"), (acc["at"] + F.char_length(x["m"])).alias("e"), x["m"].alias("m"))
        return F.struct((acc["at"] + x["n"]).alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    def placed(items: Column) -> Column:
        part = lambda b: F.slice(items, b * MATCHES + 1, F.lit(MATCHES))
        sums = F.transform(blocks(F.size(items), MATCHES), lambda b: F.aggregate(part(b), F.lit(0), lambda acc, x: acc + x["n"]))
        starts = F.aggregate(sums, F.array(F.char_length(cut[0])), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
        start = lambda of, b: F.struct(of[b].alias("at"), F.array().cast(SPAN).alias("out"))
        return bound(starts, lambda of: F.flatten(F.transform(blocks(F.size(items), MATCHES), lambda b: F.aggregate(part(b), start(of, b), step, lambda acc: acc["out"]))))

    return bound(items, placed)


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(m: Column) -> Column:
    d = F.reverse(digits(m))

    def term(i: Column) -> Column:
        v = F.substring(d, i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, v).when(v > 4, 2 * v - 9).otherwise(2 * v)

    n = F.char_length(d)
    return n.between(14, 19) & (F.aggregate(F.transform(F.sequence(F.lit(1), F.greatest(F.least(n, F.lit(19)), F.lit(1))), term), F.lit(0), lambda a, x: a + x) % 10 == 0)


def found(docs: DataFrame, text: str, p: str = "_") -> DataFrame:
    """Adds, for each kind, {p}{kind}: the base spans; and {p}t, the text they were read from."""
    none = F.array().cast("array<string>")
    t = F.col(f"{p}t")
    docs = docs.withColumn(f"{p}t", F.regexp_replace(F.coalesce(F.col(text), F.lit("")), f"[{JOIN}-{CLOSE}]", "\ufffd"))
    cut = {
        "email": F.when(t.contains("@"), pieces(F.regexp_replace(t, r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", DOT), EMAIL)),
        "ip": F.when(t.rlike(r"[0-9]\.[0-9]++\."), pieces(t, IP)),
        "card": F.when(t.rlike("(?:[0-9][ -]?){14}"), pieces(F.regexp_replace(t, "(?<=[0-9])[ -](?=[0-9])", JOIN), CARD)),
        "phone": F.when(t.contains("+"), pieces(t, PHONE)),
    }
    valid = {
        "email": lambda x: F.lit(True),
        "ip": lambda x: x["m"].rlike(rf"^{OCTET}\.{OCTET}\.{OCTET}\.{OCTET}$"),
        "card": lambda x: luhn(x["m"]),
        "phone": lambda x: F.char_length(digits(x["m"])).between(10, 15),
    }
    docs = docs.withColumns({f"{p}{k}": F.coalesce(cut[k], none) for k in KINDS})
    return docs.withColumns({f"{p}{k}": F.when(F.size(f"{p}{k}") > 1, F.filter(spans(F.col(f"{p}{k}")), valid[k])).otherwise(F.array().cast(SPAN)) for k in KINDS})


def base(p: str = "_") -> Column:
    """All base spans by start, then kind."""

    def of(i: int, k: str) -> Column:
        return F.transform(f"{p}{k}", lambda x: F.struct(x["s"].alias("s"), F.lit(i).alias("i"), x["e"].alias("e"), F.lit(k).alias("kind")))

    return F.array_sort(F.concat(*[of(i, k) for i, k in enumerate(KINDS)]))


def parted(t: Column) -> Column:
    """A text in parts of PART code points."""
    return F.regexp_extract_all(t, F.lit(rf"(?s).{{1,{PART}}}"), F.lit(0))


def patterns(parts: Column, s: Column) -> Column:
    """The lexical patterns to the left of place s of a text in parts: the two words before it, and the last one alone if it ends in a colon or equals sign."""
    k = F.floor(s / PART).cast("int")
    near = F.concat(F.when(k > 0, F.get(parts, k - 1)).otherwise(""), F.coalesce(F.get(parts, k), F.lit("")))
    at = s - F.greatest(k - 1, F.lit(0)) * PART
    left = F.lower(F.substring(near, F.greatest(at - LEFT, F.lit(0)) + 1, F.least(at, F.lit(LEFT))))

    def of(left: Column) -> Column:
        two = F.regexp_replace(F.regexp_extract(left, r"(\S+\s+\S+)[\s\"'(<\[]*$", 1), r"\s+", " ")
        cue = F.regexp_extract(left, r"([^\s:=]+\s?[:=])[\s\"'(<\[]*$", 1)
        return F.filter(F.array(two, cue), lambda w: w != "")

    return bound(F.when(s > LEFT, F.regexp_replace(left, r"^\S+", "")).otherwise(left), of)


def mentions(parts: Column, p: str = "_") -> Column:
    """Seeds, and candidates (kind null) that touch no seed, with their patterns."""

    def of(k: str) -> Column:
        value = {"email": lambda m: F.translate(m, DOT, "."), "card": digits}.get(k, lambda m: m)
        return F.transform(f"{p}{k}", lambda x: F.struct(F.lit(k).alias("kind"), x["s"].alias("s"), x["e"].alias("e"), value(x["m"]).alias("v"), patterns(parts, x["s"]).alias("w")))

    none = F.array().cast(MENTION)
    more = F.transform(f"{p}free", lambda c: F.struct(F.lit(None).cast("string").alias("kind"), c["s"].alias("s"), c["e"].alias("e"), c["m"].alias("v"), patterns(parts, c["s"]).alias("w")))
    return F.concat(*[F.when(F.size(f"{p}{k}") > 0, of(k).cast(MENTION)).otherwise(none) for k in KINDS], F.when(F.size(f"{p}free") > 0, more.cast(MENTION)).otherwise(none))


def free(found: Column, taken: Column) -> Column:
    """Of the spans `found`, in order and disjoint, those of five code points or more that touch none of `taken`, in order of their starts.

    Both are walked by blocks of MATCHES of `found`; a block meets only what of `taken` lies about its stretch."""

    def of(found: Column) -> Column:
        def part(some: Column) -> Column:
            about = F.filter(taken, lambda b: (b["s"] < F.element_at(some, -1)["e"]) & (some[0]["s"] < b["e"]))
            return bound(about, lambda about: F.filter(some, lambda c: ~F.exists(about, lambda b: (b["s"] < c["e"]) & (c["s"] < b["e"]))))

        return F.flatten(F.transform(blocks(F.size(found), MATCHES), lambda k: bound(F.slice(found, k * MATCHES + 1, F.lit(MATCHES)), part)))

    return bound(F.filter(found, lambda c: c["e"] - c["s"] >= 5), of)


def read(docs: DataFrame, text: str = "text", p: str = "_") -> DataFrame:
    """Adds {p}base, {p}said (mentions) and {p}key (of the text)."""
    t = F.col(f"{p}t")
    docs = found(docs, text, p).withColumn(f"{p}base", base(p))
    docs = docs.withColumn(f"{p}cut", F.when(t.rlike("[0-9@]| (?:at|[\\[(]at[\\])]) "), pieces(t, CANDIDATE)))
    docs = docs.withColumn(f"{p}free", F.when(F.size(f"{p}cut") > 1, free(spans(F.col(f"{p}cut")), F.col(f"{p}base"))).otherwise(F.array().cast(SPAN)))
    docs = docs.withColumn(f"{p}parts", F.when((F.size(f"{p}base") > 0) | (F.size(f"{p}free") > 0), parted(t)))
    return docs.withColumn(f"{p}said", mentions(F.col(f"{p}parts"), p)).withColumn(f"{p}key", F.md5(t))


def likely(v: Column) -> dict[str, Column]:
    """For each kind: whether a candidate's characters allow it."""
    n = F.char_length(digits(v))
    bare = v.rlike(r"^[0-9().+\- ]*$")
    return {"email": v.rlike(r"@|[ (\[]at[ )\]]"), "ip": v.rlike(r"^[0-9]{1,3}(?:[.-][0-9]{1,3}){3}$"), "card": n.between(12, 19) & bare, "phone": n.between(7, 15) & bare}


def trusted(said: DataFrame, rounds: int | None = None) -> DataFrame:
    """w (pattern), kind and confidence of the patterns that bootstrapping trusts. said: a row for each mention (kind, v, w). rounds:
    where to stop before confidences do; identifiers more than so many patterns away from a seed are then missed."""
    edges = written(said.select("kind", F.lower("v").alias("v"), F.explode("w").alias("w")).distinct(), "edges", few=True)
    seeds = edges.filter("kind is not null").select("w", "v", "kind", F.lit(1.0).alias("b"), F.lit(False).alias("judged"))
    allows = likely(F.col("v"))
    asked = edges.filter("kind is null").select("w", "v", *[allows[k].alias(k) for k in KINDS])
    open_ = asked.select("w", "v", F.explode(F.array_compact(F.array(*[F.when(F.col(k), F.lit(k)) for k in KINDS]))).alias("kind"))
    # Of each pattern: its seeds, and the candidates that can't be of a kind.
    sizes = edges.select("w", F.col("kind").isNotNull().alias("seed"), *[(F.col("kind").isNull() & ~allows[k]).alias(k) for k in KINDS])
    sizes = sizes.groupBy("w").agg(F.count_if("seed").alias("seeds"), *[F.count_if(k).alias(k) for k in KINDS])
    # Patterns of one instance support nothing in any round, and need not be followed.
    several = edges.groupBy("w").agg(F.count_distinct("v").alias("n")).filter(F.col("n") >= SUPPORT).select("w")
    sizes, open_ = written(sizes.join(several, "w", "left_semi"), "sizes", few=True), written(open_.join(several, "w", "left_semi"), "open", few=True)
    now, past, score, earlier = seeds, set(), None, None
    for _ in itertools.count() if rounds is None else range(rounds):
        per = now.groupBy("w", "kind").agg(F.sum("b").alias("b"), F.count_if(F.col("b") >= CONFIDENCE).alias("support"), F.count_if("judged").alias("judged")).filter(F.col("support") >= SUPPORT)
        wrong = F.coalesce(*[F.when(F.col("kind") == k, F.col(k)) for k in KINDS])
        score = per.join(sizes, "w").select("w", "kind", (F.col("b") / (F.col("seeds") + F.col("judged") + wrong + 1)).alias("confidence"))
        score = written(score.filter(F.col("confidence") >= CONFIDENCE / 2), "patterns", instead_of=earlier, few=True)
        earlier = score
        # Without a pattern that is trusted, none will be: what the others find is worth less than the confidence they lack.
        state = tuple(score.agg(F.count_if(F.col("confidence") >= CONFIDENCE), F.count(F.lit(1)), F.bit_xor(F.xxhash64("w", "kind", F.round(F.col("confidence") * 1e6).cast("long")))).first())
        if state in past or not state[0]:
            break
        past.add(state)
        reached = open_.join(score, ["w", "kind"]).groupBy("v", "kind").agg(F.max("confidence").alias("b"))
        now = seeds.unionByName(open_.join(reached, ["v", "kind"]).select("w", "v", "kind", "b", F.lit(True).alias("judged")))
    return score.filter(F.col("confidence") >= CONFIDENCE)


def discovered(told: DataFrame, p: str = "_") -> DataFrame:
    """doc_id, {p}key and more (spans of kind:start:end as structs) where trusted patterns mark candidates. told: doc_id, {p}key, {p}said."""
    one = told.select("doc_id", f"{p}key", F.explode(f"{p}said").alias("x")).select("doc_id", f"{p}key", "x.*")
    allows = likely(F.lower("v"))
    kinds = F.array_compact(F.array(*[F.when(allows[k], F.lit(k)) for k in KINDS]))
    asked = one.filter("kind is null").drop("kind").withColumn("kind", F.explode(kinds)).withColumn("w", F.explode("w"))
    best = asked.join(trusted(one), ["w", "kind"])
    best = best.groupBy("doc_id", f"{p}key", "s", "e").agg(F.max_by("kind", F.struct("confidence", "kind")).alias("kind"))
    number = F.element_at(F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)]), F.col("kind"))
    return best.groupBy("doc_id", f"{p}key").agg(F.collect_set(F.struct("s", number.alias("i"), "e", "kind")).alias("more"))


def listed(all_: Column) -> Column:
    return F.array_join(F.transform(all_, lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"])), ",")


def same(told: DataFrame, extra: DataFrame, p: str = "_") -> DataFrame:
    extra = extra.withColumnsRenamed({"doc_id": f"{p}id2", f"{p}key": f"{p}key2", "more": f"{p}more"})
    joined = told.join(extra, F.col("doc_id").eqNullSafe(F.col(f"{p}id2")) & (F.col(f"{p}key") == F.col(f"{p}key2")), "left").drop(f"{p}id2", f"{p}key2")
    return joined.withColumn(f"{p}all", F.when(F.col(f"{p}more").isNull(), F.col(f"{p}base")).otherwise(F.array_sort(F.concat(F.col(f"{p}base"), F.col(f"{p}more")))))


def detect(docs: DataFrame) -> DataFrame:
    """doc_id, a count for each kind of base span, base (all of these) and spans (those of the method too) of every row of docs (doc_id, text)."""
    told = written(read(docs.select("doc_id", "text")).select("doc_id", *[F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in KINDS], "_base", "_said", "_key"), "mentions")
    return same(told, discovered(told)).select("doc_id", *[f"n_{k}" for k in KINDS], listed(F.col("_base")).alias("base"), listed(F.col("_all")).alias("spans"))


def redacted(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with each span of `text` replaced by its kind in brackets; spans that overlap go together, under the first one's kind. n_chars, if there, is counted anew.

    A text is rewritten part by part (PART code points), each with the spans that reach into it."""
    p = "__pii_"
    names = {c: f"{p}col_{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", text)}
    told = read(docs.withColumnsRenamed(names), text, p).select("doc_id", text, *names.values(), f"{p}base", f"{p}said", f"{p}key")
    told = written(told, "mentions")
    extra = discovered(told.select("doc_id", f"{p}key", f"{p}said"), p)
    told = same(told.drop(f"{p}said"), extra, p)
    all_ = F.col(f"{p}all")

    def rewritten(part: Column, k: Column) -> Column:
        low, high = k * PART, k * PART + F.char_length(part)
        here = F.filter(all_, lambda x: (x["s"] < high) & (x["e"] > low))
        start = F.struct(low.alias("at"), F.lit("").alias("out"))

        def step(acc: Column, x: Column) -> Column:
            kept = F.substring(part, acc["at"] - low + 1, F.greatest(x["s"] - acc["at"], F.lit(0)))
            name = F.when(x["s"] >= acc["at"], F.upper(F.concat(F.lit("["), x["kind"], F.lit("]")))).otherwise("")
            return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), F.concat(acc["out"], kept, name).alias("out"))

        return F.aggregate(here, start, step, lambda acc: F.concat(acc["out"], F.substring(part, F.least(acc["at"], high) - low + 1, high - F.least(acc["at"], high))))

    clean = F.array_join(F.transform(parted(F.col(text)), rewritten), "")
    told = told.withColumn(text, F.when(F.size(f"{p}all") > 0, clean).otherwise(F.col(text)))
    told = told.select(*[F.col(names.get(c, c)).alias(c) for c in docs.columns])
    return told.withColumn("n_chars", F.char_length(text).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else told

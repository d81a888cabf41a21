"""Personal data by exact patterns and bootstrapped contextual extraction.

Four kinds are found exactly: email, ip, card, phone, leftmost and without
overlap per kind, with code point offsets. These seed the method. A candidate is
a token of the text with a digit or a mark of addresses, the own span of a seed
with blanks inside, or a run of up to `WORDS` words of digits that touches no
span; it has an instance (its text), and lexical patterns: its shape (runs of
letters and digits with their lengths) alone, and its coarse shape after the word
before it. Patterns and instances form a graph. Seeds start with confidence 1; then
Spark repeats, on the edges only: a pattern's confidence is the smoothed mean
confidence of its different instances, and an instance's is the square of the best
of its patterns'. So a pattern without any seed is trusted once patterns that are
trusted cover its instances, and leads on to others. Tokens of patterns that end
above `ACCEPT` with enough different instances, and that are no seed, become new
spans of the kind that most of the pattern's confidence stands for, but for those
within a longer new one.

All of it is DataFrame expressions: spans come from interleaving the pieces that
split and regexp_extract_all give. The regular expressions are possessive where
that cannot change a match, so long runs neither backtrack nor overflow, and texts,
tokens and contexts count in full whatever their length. The texts are read twice:
once for candidates, which are kept as a table, and once for the result.

Null text is empty. Rows that repeat an id and a text share their findings. Ids are
of any type. Columns named like the results are replaced, others are kept apart from
those used within. Empty tables give no rows; without seeds there are no patterns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import Work, cut

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 3
ACCEPT = 0.9
SUPPORT = 20
#: Accepted patterns, and texts with new spans, up to this many rows are broadcast.
BROADCAST_PATTERNS = 100_000

# A failing run of address characters fails from each of its places, so only its first place, or the end of the last match, is tried.
_LOCAL = r"[A-Za-z0-9._%+-]"
_REGEX = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_SPAN = "array<struct<kind:string,start:int,end:int>>"
_TOKEN = r"[^\s]*[0-9@][^\s]*"
#: Words of digits with blanks between them. No kind with blanks has fewer digits than DIGITS[0] or more than DIGITS[1], so no more words either.
_RUN = r"(?<![A-Za-z0-9+(.-])\+?[0-9][0-9().-]*+(?:\x20++\+?\(?[0-9][0-9().-]*+)++"
DIGITS = (8, 19)
WORDS = 19


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the digits, counted from the right, add to a multiple of ten."""
    def add(total: Column, i: Column) -> Column:
        d = F.substring(F.reverse(digits), i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _valid(kind: str, x: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(x, r"\."), lambda p: F.coalesce(p.try_cast("long"), F.lit(256)) <= 255)
    if kind == "card":
        d = _digits(x)
        return F.length(d).between(16, 19) & F.when(F.length(d).between(16, 19), _luhn(d)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(x)).between(8, 15)
    return F.lit(True)


_LAST_WORD = r"(?<!\S)(\S++)\s*+$"
_PLACES = "array<struct<start:int,match:string,lead:string>>"


def _positions(text: Column, regex: str, gate: Column) -> Column:
    """array<struct<start, match, lead>> of a regex: lengths of the pieces between matches give the starts.

    lead is the word before the match, or what stands of it if the match begins within a word.
    """
    matches = F.regexp_extract_all(text, F.lit(regex), F.lit(0))
    pieces = F.split(text, regex, -1)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("last"), F.array().cast(_PLACES).alias("out"))
    word = lambda x: F.regexp_extract(x, _LAST_WORD, 1)

    def step(state: Column, pair: Column) -> Column:
        at = state["at"] + F.length(pair["piece"])
        lead = F.when(~pair["piece"].rlike(r"\S"), word(state["last"])).otherwise(word(pair["piece"]))
        return F.struct(
            (at + F.length(pair["match"])).alias("at"),
            pair["match"].alias("last"),
            F.concat(state["out"], F.array(F.struct(at.alias("start"), pair["match"].alias("match"), lead.alias("lead")))).alias("out"),
        )

    pairs = F.zip_with(F.slice(pieces, F.lit(1), F.size(matches)), matches, lambda p, m: F.struct(p.alias("piece"), m.alias("match")))
    found = F.aggregate(pairs, start, step, lambda s: s["out"])
    return F.when(gate, found).otherwise(F.array().cast(_PLACES))


def base_spans(text: Column, kind: str) -> Column:
    """array<struct<kind, start, end, lead, match>>."""
    gate = {
        "email": F.contains(text, F.lit("@")),
        "ip": text.rlike(r"[0-9]\.[0-9]"),
        "card": text.rlike(r"[0-9][\x20-]?[0-9]"),
        "phone": F.contains(text, F.lit("+")),
    }[kind]
    found = F.filter(_positions(text, _REGEX[kind], gate), lambda m: _valid(kind, m["match"]))
    return F.transform(found, lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), (m["start"] + F.length(m["match"])).alias("end"), m["lead"].alias("lead"), m["match"].alias("match")))


def with_base(docs: DataFrame, text: str, carry: list[Column]) -> DataFrame:
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(*carry, t.alias("_t"))
    return rows.withColumns({f"_{k}": base_spans(F.col("_t"), k) for k in KINDS})


def candidates(based: DataFrame) -> DataFrame:
    """One row per token that could be an identifier: _key, start, end, token, before, seed kind."""
    text = F.col("_t")
    tokens = _positions(text, _TOKEN, text.rlike("[0-9@]"))
    spans = F.concat(*(F.col(f"_{k}") for k in KINDS))
    rows = based.select("_key", spans.alias("spans"), F.explode(tokens).alias("x"))
    rows = rows.select("_key", "spans", (F.col("x")["start"]).alias("start"), F.col("x")["lead"].alias("before"), F.regexp_replace(F.col("x")["match"], r"[.,;:!?)\"']++$", "").alias("token"))
    end = F.col("start") + F.length("token")
    touched = F.exists("spans", lambda s: (s["start"] < end) & (s["end"] > F.col("start")))
    held = F.filter("spans", lambda s: (s["start"] >= F.col("start")) & (s["end"] <= end))
    rows = rows.select("_key", "start", end.alias("end"), "token", F.lower("before").alias("before"), F.try_element_at(held, F.lit(1))["kind"].alias("seed"), touched.alias("known"))
    return rows.filter((F.length("token") > 0) & (F.col("seed").isNotNull() | ~F.col("known")))  # parts of spans are no candidates


def joined_candidates(based: DataFrame) -> DataFrame:
    """Candidates with blanks inside, with the columns of `candidates`: own spans of seeds, and runs of words that touch no span."""
    text = F.col("_t")
    spans = F.concat(*(F.col(f"_{k}") for k in ("card", "phone")))
    blank = F.filter(spans, lambda s: F.contains(s["match"], F.lit(" ")))
    own = based.filter(text.rlike(r"\+[0-9]|[0-9]\x20[0-9]")).select("_key", F.explode(blank).alias("s"))
    seeds = own.select("_key", "s.start", "s.end", F.col("s.match").alias("token"), F.lower("s.lead").alias("before"), F.col("s.kind").alias("seed"), F.lit(True).alias("known"))

    gate = text.rlike(r"[0-9][0-9().-]*+\x20++\+?\(?[0-9]")
    every = F.concat(*(F.col(f"_{k}") for k in KINDS))
    rows = based.filter(gate).select("_key", every.alias("spans"), F.explode(_positions(text, _RUN, F.lit(True))).alias("x"))
    far = F.col("x")["start"] + F.length(F.col("x")["match"])
    near = F.filter("spans", lambda s: (s["start"] < far) & (s["end"] > F.col("x")["start"]))
    rows = rows.select("_key", F.col("x")["start"].alias("at"), F.col("x")["lead"].alias("lead"), near.alias("spans"), _positions(F.col("x")["match"], r"[^\x20]++", F.lit(True)).alias("words"))
    rows = rows.select("_key", "at", "lead", "spans", F.explode(F.transform("words", lambda w, i: F.struct(F.when(i > 0, F.get("words", i - 1)["match"]).alias("last"), F.slice("words", i + 1, WORDS).alias("words")))).alias("y"))
    rows = rows.select("_key", "at", "spans", F.coalesce("y.last", "lead").alias("before"), F.col("y.words").alias("words"))
    rows = rows.select("*", F.explode(F.when(F.size("words") > 1, F.sequence(F.lit(2), F.size("words")))).alias("k"))
    first = F.col("words")[0]["start"]
    whole = F.aggregate(F.slice("words", F.lit(1), F.col("k")), F.lit(""), lambda a, w: F.concat(F.rpad(a, w["start"] - first, " "), w["match"]))
    rows = rows.select("_key", "spans", "before", (F.col("at") + first).alias("start"), F.regexp_replace(whole, "[^0-9]++$", "").alias("token"))
    end = F.col("start") + F.length("token")
    free = ~F.exists("spans", lambda s: (s["start"] < end) & (s["end"] > F.col("start")))
    rows = rows.filter(F.length(_digits(F.col("token"))).between(*DIGITS) & free)
    return seeds.unionByName(rows.select("_key", "start", end.alias("end"), "token", F.lower("before").alias("before"), F.lit(None).cast("string").alias("seed"), F.lit(False).alias("known")))


def _shape(token: Column, counted: bool) -> Column:
    """Letters become a or A and digits 9; runs are counted or folded."""
    x = F.regexp_replace(F.regexp_replace(F.regexp_replace(token, "[a-z]", "a"), "[A-Z]", "A"), "[0-9]", "9")
    return x if counted else F.regexp_replace(x, r"(.)\1+", "$1")


def patterns_of(found: DataFrame) -> DataFrame:
    """Candidates with their lexical patterns, one row for each."""
    return found.withColumn(
        "pattern",
        F.explode(F.array(F.concat(F.lit("shape "), _shape(F.col("token"), True)), F.concat(F.lit("after "), F.col("before"), F.lit(" "), _shape(F.col("token"), False)))),
    )


def score_patterns(found: DataFrame, rounds: int = ROUNDS, accept: float = ACCEPT, support: int = SUPPORT) -> DataFrame:
    """(pattern, kind, confidence) of the patterns that are trusted after the last round."""
    with Work(found.sparkSession) as work:
        edges = patterns_of(found).groupBy("pattern", F.xxhash64("token").alias("instance")).agg(F.max("seed").alias("seed"))
        edges = work.keep(edges)
        wide = edges.groupBy("pattern").agg(F.count("*").alias("size")).filter(F.col("size") >= support)
        edges = work.keep(edges.join(wide, "pattern"))
        own = work.keep(edges.groupBy("instance").agg(F.max("seed").alias("seed")))
        belief = own.filter("seed is not null").select("instance", F.col("seed").alias("kind"), F.lit(1.0).alias("belief"))
        scored = None
        for r in range(rounds):
            votes = edges.select("pattern", "size", "instance").join(belief, "instance").groupBy("pattern", "size", "kind").agg(F.sum("belief").alias("votes"))
            scored = votes.groupBy("pattern", "size").agg(F.sum("votes").alias("sum"), F.max(F.struct("votes", "kind"))["kind"].alias("kind"))
            scored = work.keep(scored.select("pattern", "kind", (F.col("sum") / (F.col("size") + 1)).alias("confidence")))
            if r < rounds - 1:
                best = edges.select("pattern", "instance").join(scored, "pattern").groupBy("instance").agg(F.max(F.struct("confidence", "kind")).alias("x"))
                told = best.join(own, "instance").select("instance", F.coalesce("seed", "x.kind").alias("kind"), F.when(F.col("seed").isNotNull(), 1.0).otherwise(F.col("x.confidence") * F.col("x.confidence")).alias("belief"))
                belief = work.keep(told)
        return cut(scored.filter(F.col("confidence") >= accept))


def find_personal_data(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", carry: list[str] | None = None, base: str = "base_spans", out: str = "spans"
) -> DataFrame:
    """The carried columns (all if None) with array columns `base` and `out` of (kind, start, end), by kind and start."""
    keep = [c for c in (docs.columns if carry is None else carry) if c not in (base, out)]
    key = F.xxhash64(F.col(doc_id), F.col(text)).alias("_key")
    based = with_base(docs, text, [key])
    with Work(docs.sparkSession) as work:
        found = work.keep(candidates(based).unionByName(joined_candidates(based)))
        trusted = score_patterns(found)
        if trusted.count() <= BROADCAST_PATTERNS:
            trusted = F.broadcast(trusted)
        hits = patterns_of(found.filter(~F.col("known"))).join(trusted, "pattern")
        best = hits.groupBy("_key", "start", "end").agg(F.max_by("kind", F.struct("confidence", "kind")).alias("kind"))
        new = best.groupBy("_key").agg(F.collect_set(F.struct("kind", "start", "end")).alias("_new"))
        longest = F.filter("_new", lambda s: ~F.exists("_new", lambda g: (g["start"] <= s["start"]) & (g["end"] >= s["end"]) & (g["end"] - g["start"] > s["end"] - s["start"])))
        added = cut(new.select("_key", longest.alias("_new")))
    if added.count() <= BROADCAST_PATTERNS:
        added = F.broadcast(added)
    whole = with_base(docs, text, [key, *(F.col(c).alias(f"c{i}") for i, c in enumerate(keep))]).join(added, "_key", "left")
    rank = lambda k: F.array_position(F.array(*map(F.lit, KINDS)), k)

    def in_order(spans: Column) -> Column:
        keyed = F.array_sort(F.transform(spans, lambda s: F.struct(rank(s["kind"]).alias("r"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
        return F.transform(keyed, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))

    own = F.transform(F.concat(*(F.col(f"_{k}") for k in KINDS)), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return whole.select(
        *(F.col(f"c{i}").alias(c) for i, c in enumerate(keep)),
        own.alias(base),
        in_order(F.concat(own, F.coalesce("_new", F.array().cast(_SPAN)))).alias(out),
    )


def _join(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    count = lambda k: F.size(F.filter("base_spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(doc_id, *(count(k) for k in KINDS), F.sha2(_join("base_spans"), 256).alias("base_sha256"), _join("spans").alias("spans"))


def mask(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with each found span of text replaced by its kind in brackets; same columns."""
    found = find_personal_data(docs, doc_id, text, base="_base", out="_spans")
    t = F.col(text)
    starts = F.array_sort(F.transform("_spans", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("end"), s["kind"].alias("kind"))))
    state = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a: Column, s: Column) -> Column:
        end = -s["end"]
        gap = F.when(s["start"] >= a["at"], F.concat(F.substring(t, a["at"] + 1, s["start"] - a["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise(F.lit(""))
        return F.struct(F.greatest(a["at"], end).alias("at"), F.concat(a["out"], gap).alias("out"))

    masked = F.aggregate(starts, state, step, lambda a: F.concat(a["out"], F.substring(t, a["at"] + 1, F.length(t))))
    return found.select(*(F.when(F.size("_spans") > 0, masked).otherwise(t).alias(c) if c == text else F.col(c) for c in docs.columns))

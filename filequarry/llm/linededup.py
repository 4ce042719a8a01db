"""Line dedup by winnowing over stretches of words, in DataFrame functions only.

Texts are sequences of words, told apart by any white space, so that a passage set into the middle of a line is seen like
one that stands on lines of its own, in any script. A fingerprint is the hash of NOISE words. It is taken where the hash
of a word and its neighbour is low, and in a window of NOISE places that has no low one where it is the smallest, so any
two equal runs of twice NOISE words share one wherever they stand.

A fingerprint's NOISE words go wherever it stands but at the first place. Consecutive fingerprints of a run overlap or
touch, so only the words before the first and after the last, NOISE at most each, must be compared: with those around all
earlier places of the fingerprint. Each beginning of the words around is filed with the first place that has it, and the
longest one that an earlier place has too goes as well. Places are ordered by doc_id, text key and word; later copies of
a whole text are told by their key and take no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, forget, perhaps_in, row_id, text_key, unused, written

#: Shorter equal runs are never deleted; equal runs of twice as many words always are.
NOISE = 20
#: Where a unit begins: at a word after white space. White space before a text's first word is a unit of its own.
UNIT_START = r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])"
#: Low bits of a mark hold its place; a mark is low if its hash is in the lowest eighth.
_PLACE, _LOW = (1 << 27) - 1, -(1 << 63) + (1 << 61)


def units_of(text: Column) -> Column:
    """The units of a text, in order: words with the white space after them; joined they are the text again."""
    return F.split(F.coalesce(text, F.lit("")), UNIT_START, -1)


def words_in(text: Column) -> Column:
    """The words of a text; a blank one has one empty word."""
    text = F.coalesce(text, F.lit(""))
    # words between single blanks or line feeds, as in most texts, are told apart without the pattern engine
    plain = F.replace(text, F.lit("\n"), F.lit(" "))
    odd = lambda p: text.rlike(r"[\x09\x0B-\x0D]") | p.contains("  ") | p.startswith(" ") | p.endswith(" ")
    blanks = F.split(F.trim(text, F.lit(" \t\n\x0b\f\r")), SPACES, -1)
    return F.get(F.transform(F.array(plain), lambda p: F.when(odd(p), blanks).otherwise(F.split(p, " ", -1))), F.lit(0))


def _let(name: str, value: str, body: str) -> str:
    """SQL for body with name standing for value, which is worked out once and never copied between rows."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def fingerprints(docs: DataFrame, noise: int = NOISE) -> DataFrame:
    """(id, text_key, picks, again) of each row: places (g, at) of fingerprints, the first of each in the text, and repeats."""
    # places count from 0 here; windows are ``wide`` places, and m places have a fingerprint at all
    marks = f"transform(h, (x, k) -> ((x ^ shiftleft(get(h, k + 1), 1)) & {-_PLACE - 1}L) | k)"
    low = f"transform(filter(marks, x -> x < {_LOW}L and x & {_PLACE}L < m), x -> cast(x & {_PLACE}L as int))"
    # stretches of places without a low mark that are as long as a window: all their windows are looked at
    begin, end = "coalesce(get(low, k - 1), -1) + 1", "coalesce(get(low, k), m)"
    bare = f"if(m < 1, cast(array() as array<int>), filter(sequence(0, size(low)), k -> {end} - ({begin}) >= wide))"
    smallest = f"least({', '.join(f'get(marks, s + {q})' for q in range(noise))}, {2**63 - 1}L)"
    windows = f"flatten(transform(bare, k -> transform(sequence({begin}, {end} - wide), s -> cast({smallest} & {_PLACE}L as int))))"
    # a text of few places is one window
    few = f"array(cast(array_min(slice(marks, 1, m)) & {_PLACE}L as int))"
    at = f"if(size(bare) = 0, low, if(m < {noise}, {few}, sort_array(array_distinct(concat(low, {windows})))))"
    grams = f"transform(at, i -> xxhash64({', '.join(f'get(h, i + {q})' for q in range(noise))}))"
    # words that two places may share before one is the place of a low mark, which would be shared as well
    gap = "if(coalesce(get(marks, get(at, {j})) < {low}L, false), least(abs(x - get(at, {j})) - 1, {noise}), {noise})"
    l, r = (f"transform(at, (x, j) -> cast({gap.format(j=j, low=_LOW, noise=noise)} as tinyint))" for j in ("j - 1", "j + 1"))
    told = _let("at", at, f"named_struct('at', at, 'g', {grams}, 'l', {l}, 'r', {r})")
    for name, value in (("bare", bare), ("low", low), ("wide", f"least(m, {noise})"), ("m", f"size(h) - {noise - 1}"), ("marks", marks), ("h", "transform(w, x -> xxhash64(x))")):
        told = _let(name, value, told)
    d = docs.select(row_id().alias("id"), text_key(F.col("text")).alias("text_key"), words_in(F.col("text")).alias("w"))
    d = d.select("id", "text_key", F.expr(told).alias("f")).select("id", "text_key", "f.at", "f.g", "f.l", "f.r")
    d = d.withColumn("twice", F.expr("size(array_distinct(g)) < size(g)"))
    # fingerprints with their places in order: sorted as numbers, unless two of one text begin with the same bits
    begins = f"transform(g, x -> x & {-_PLACE - 1}L)"
    numbers = f"transform(sort_array(transform(g, (x, j) -> (x & {-_PLACE - 1}L) | j)), x -> cast(x & {_PLACE}L as int))"
    pairs = "transform(sort_array(transform(g, (x, j) -> named_struct('g', x, 'j', j))), x -> x.j)"
    d = d.withColumn("nth", F.expr(f"if(twice, if(size(array_distinct({begins})) = size(array_distinct(g)), {numbers}, {pairs}), null)"))
    last = "get(nth, k - 1)"
    first = f"transform(filter(nth, (j, k) -> k = 0 or get(g, {last}) <> get(g, j)), j -> named_struct('g', get(g, j), 'at', get(at, j) + 1, 'l', get(l, j), 'r', get(r, j)))"
    later = f"transform(nth, (j, k) -> if(get(g, {last}) = get(g, j), named_struct('g', get(g, j), 'at', get(at, j) + 1, 'l', get(l, j), 'r', get(r, j)), null))"
    return d.select(
        "id", "text_key",
        F.expr(f"if(twice, {first}, transform(g, (x, j) -> named_struct('g', x, 'at', get(at, j) + 1, 'l', get(l, j), 'r', get(r, j))))").alias("picks"),
        F.expr(f"if(twice, filter({later}, x -> x is not null), cast(array() as array<struct<g:bigint,at:int,l:tinyint,r:tinyint>>))").alias("again"),
    )


def _matches(reps: DataFrame, noise: int) -> DataFrame:
    """(id, text_key, at, g, l, r, later, left, right): places of fingerprints that stand twice.

    ``l`` and ``r``: how many words before and after may be shared with another place, if no place beside is.

    ``later``: it is not the first of all; ``left`` and ``right``: no other such place overlaps it or touches it there, so
    that the words must be compared. Any run that goes on beyond the one beside holds that one whole.
    """
    spread = lambda c: reps.select("id", "text_key", F.explode(c).alias("p")).select("id", "text_key", "p.*")
    places, again = spread("picks"), spread("again")
    # most fingerprints stand once: they are counted alone, and only places of others are sorted and joined
    many = written(places.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("g").union(again.select("g").distinct()), "many")
    places = written(perhaps_in(places, F.col("g"), many, "hit").where("hit").drop("hit").union(again), "places")
    place = F.struct("id", "text_key", "at", "l", "r")
    shared = places.groupBy("g").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last")
    met = places.join(shared.drop("last"), "g").where(place != F.col("first"))
    met = met.groupBy("id", "text_key").agg(F.sort_array(F.collect_set(F.struct("at", "g", "l", "r"))).alias("xs"))  # a set, as rows may be repeated
    ends = f"k = 0 or x.at - get(xs, k - 1).at > {noise}", f"k = size(xs) - 1 or get(xs, k + 1).at - x.at > {noise}"
    met = met.withColumn("x", F.explode(F.expr(f"transform(xs, (x, k) -> named_struct('at', x.at, 'g', x.g, 'l', x.l, 'r', x.r, 'left', x.l > 0 and ({ends[0]}), 'right', x.r > 0 and ({ends[1]})))")))
    met = met.select("id", "text_key", "x.at", "x.g", "x.l", "x.r", F.lit(True).alias("later"), "x.left", "x.right")
    no = [F.lit(False).alias(c) for c in ("later", "left", "right")]
    out = written(met.union(shared.select("first.id", "first.text_key", "first.at", "g", "first.l", "first.r", *no)), "matches")
    for t in (many, places):
        forget(t)
    return out


def _reaches(docs: DataFrame, places: DataFrame, noise: int) -> DataFrame:
    """(id, text_key, at, prior, next) of the ends that _matches tells: the words before or after them, the nearest first, as far as an earlier place of the fingerprint has them too."""
    sides = places.where("left or right").groupBy("g").agg(F.max(F.expr("if(left, l, 0)")).alias("lefts"), F.max(F.expr("if(right, r, 0)")).alias("rights"))
    # what no end can share isn't looked at: how far the ends of a fingerprint may reach bounds how far others are filed
    places = places.join(sides, "g").select("id", "text_key", "at", "g", F.expr("least(l, lefts)").alias("l"), F.expr("least(r, rights)").alias("r"), "left", "right")
    places = written(places.where("l > 0 or r > 0"), "ends")
    wanted = places.groupBy("id", "text_key").agg(F.collect_list(F.struct("at", "g", "l", "r", "left", "right")).alias("ats"))
    texts = docs.select(row_id().alias("id"), text_key(F.col("text")).alias("text_key"), "text")
    texts = perhaps_in(texts, _key("id", "text_key"), places.select(_key("id", "text_key").alias("k")), "hit").where("hit")
    texts = texts.join(wanted, ["id", "text_key"]).select("id", "text_key", "ats", words_in(F.col("text")).alias("w"))
    texts = texts.select("id", "text_key", "ats", F.transform("w", lambda w: F.hash(w)).alias("h"))
    told = ", ".join(
        f"transform(filter(ats, x -> x.{need} > 0), x -> named_struct('at', x.at, 'g', x.g, 'side', {i}, 'end', x.{end}, 'words', slice({words}, 1, x.{need})))"
        for i, (need, end, words) in enumerate(zip(("l", "r"), ("left", "right"), _around("x.at", noise), strict=True))
    )
    around = texts.select("id", "text_key", F.explode(F.expr(f"concat({told})")).alias("c")).select("id", "text_key", "c.*").where("size(words) > 0")
    around = written(around.withColumn("h", F.xxhash64("words")), "around")
    place = F.struct("id", "text_key", "at")
    # places with the same words as far as is looked are one, the first of them; the others reach as far
    alike = written(around.groupBy("g", "side", "h").agg(F.min(F.struct(place.alias("place"), "end")).alias("first"), F.first("words").alias("words")), "alike")
    begins = "transform(sequence(1, size(words)), k -> named_struct('n', k, 'key', xxhash64(g, side, slice(words, 1, k))))"
    begins = alike.where("size(words) > 0").select("g", "side", "h", "first", F.explode(F.expr(begins)).alias("b")).select("g", "side", "h", "first", "b.n", "b.key")
    lowest = begins.groupBy("key").agg(F.min("first.place").alias("lowest"), F.max("first.place").alias("highest")).where("lowest < highest").drop("highest")
    reach = begins.where("first.end").join(lowest, "key").where("first.place > lowest").groupBy("g", "side", "h").agg(F.max("n").alias("n"))
    reach = alike.select("g", "side", "h", F.col("first.place").alias("first")).join(reach, ["g", "side", "h"], "left")
    out = around.where("end").join(reach, ["g", "side", "h"])
    out = out.withColumn("words", F.slice("words", 1, F.when(place == F.col("first"), F.coalesce("n", F.lit(0))).otherwise(F.size("words"))))
    out = written(out.select("id", "text_key", "at", F.expr("if(side = 0, words, null)").alias("prior"), F.expr("if(side = 1, words, null)").alias("next")), "reaches")
    for t in (places, around, alike):
        forget(t)
    return out


def _key(a: str, b: str) -> Column:
    return F.xxhash64(F.col(f"`{a}`"), F.col(f"`{b}`"))


def _around(at: str, noise: int) -> tuple[str, str]:
    """SQL for the hashes before a fingerprint's place, the nearest first, and after its words."""
    return f"reverse(slice(h, greatest({at} - {noise}, 1), least({noise}, {at} - 1)))", f"slice(h, {at} + {noise}, {noise})"


def repeats(docs: DataFrame, noise: int = NOISE) -> DataFrame:
    """(id, text_key, copy, far): what each text repeats of earlier ones and of itself.

    ``copy``: an earlier row has the whole text. ``far``: (at, prior, next), places of fingerprints that stand before, with
    the hashes of the words before or after them that stand before too; null where another place goes on.
    """
    once = written(fingerprints(docs, noise), "fingerprints")
    copies = written(once.groupBy("text_key").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").select("text_key", "first"), "copies")
    reps = once.join(copies, "text_key", "left").where("first is null or id = first").select("id", "text_key", "picks", "again")
    places = _matches(reps, noise)
    reaches = _reaches(docs, places, noise)
    none = F.lit(None).cast("array<int>")
    met = reaches.union(places.where("later").select("id", "text_key", "at", none, none))
    far = met.groupBy("id", "text_key").agg(F.collect_set(F.struct("at", "prior", "next")).alias("far"))
    late = once.join(copies, "text_key").where("id > first").select("id", "text_key").distinct()
    kinds = {"copy": "boolean", "far": far.schema["far"].dataType.simpleString()}
    both = [x.select("id", "text_key", *[(F.lit(True) if k == "copy" == name else F.col(k) if k == name else F.lit(None).cast(t)).alias(k) for k, t in kinds.items()]) for x, name in ((far, "far"), (late, "copy"))]
    every = both[0].union(both[1]).groupBy("id", "text_key")
    out = written(every.agg(*[F.first(k, ignorenulls=True).alias(k) for k in kinds]), "repeats")
    for t in (once, copies, places, reaches):
        forget(t)
    return out


def _same(x: str, y: str, noise: int) -> str:
    """SQL for how many words are equal: of two SQL forms of the word at a step, noise steps at most; null equals nothing."""
    return "case " + " ".join(f"when not coalesce({x.format(q)} = {y.format(q)}, false) then {q}" for q in range(noise)) + f" else {noise} end"


def line_dedup(docs: DataFrame, noise: int = NOISE) -> DataFrame:
    """docs with later repeated runs deleted from text, and with n_units and runs (the deleted ones, by word) added.

    Of any run of ``2 * noise`` words or more that stands twice, in one text or two, nothing remains at the later place.
    Nothing shorter than ``noise`` words is deleted by itself. Null texts stay null, empty ones empty. Rows with a null
    doc_id come before all others. Repeated rows, with the same doc_id and text, count as one document and all get its
    result. Other columns stay, whatever their names; columns named n_units or runs are replaced. n_units is null where
    nothing was deleted. An empty table gives an empty result.
    """
    found = repeats(docs, noise)
    plain = docs.drop("n_units", "runs")
    i, k, hit = names = unused(plain, "id", "text_key", "hit")
    keyed = plain.withColumn(i, row_id()).withColumn(k, text_key(F.col("text")))
    keyed = perhaps_in(keyed, _key(i, k), found.select(_key("id", "text_key").alias("k")), hit)
    none = F.array().cast("array<struct<s:int,e:int>>")
    columns = [F.col(f"`{c}`") for c in docs.columns if c not in ("n_units", "runs")]
    untouched = keyed.where(~F.col(hit)).select(*columns, F.lit(None).cast("int").alias("n_units"), none.alias("runs"))
    # the user's columns go through the join as one, so that no name can clash
    rows = keyed.where(F.col(hit)).select(F.col(i).alias("id"), F.col(k).alias("text_key"), F.struct(*columns).alias("row"))
    d = rows.join(found, ["id", "text_key"], "left")
    touched = F.expr("coalesce(copy, false) or far is not null")
    d = d.withColumn("text", F.when(touched, F.col("row.text")))
    d = d.withColumn("w", F.when(F.col("text").isNotNull(), words_in(F.col("text"))))
    before, after = "get(w, x.{} - 2 - {{}})", f"get(w, x.{{}} + {noise - 1} + {{{{}}}})"
    hashed = lambda w: f"if({w} is null, null, hash({w}))"
    run = f"named_struct('at', x.at, 's', cast(x.at - ({{}}) as int), 'e', cast(x.at + {noise - 1} + ({{}}) as int))"
    far = run.format(_same("get(x.prior, {})", hashed(before.format("at")).replace("{}", "{0}"), noise), _same("get(x.next, {})", hashed(after.format("at")).replace("{}", "{0}"), noise))
    empty = "cast(array() as array<struct<at:int,s:int,e:int>>)"
    every = f"sort_array(coalesce(transform(far, x -> {far}), {empty}))"
    d = d.withColumn("f", F.expr(f"if(w is null, null, {_let('w', 'w', f"named_struct('n', size(w), 'found', {every})")})"))
    d = d.select("row", "copy", "text", F.col("f.n").alias("n"), F.col("f.found").alias("found"))
    d = d.withColumn("found", F.expr(f"if(copy and n >= {noise}, array(named_struct('at', 1, 's', 1, 'e', n)), found)"))
    # runs in order of the places they grew from: each reaches over at most noise words beyond its fingerprint, so only
    # runs of so many places around it, three for each at most, can begin earlier or end later than it; they are looked at just
    # where a run doesn't touch the one before
    near = 4 * noise
    low = f"array_min(transform(slice(found, {{0}} + 1, {near}), y -> y.s))"
    high = f"array_max(transform(slice(found, greatest({{0}} + 2 - {near}, 1), least({{0}} + 1, {near})), y -> y.e))"
    apart = f"get(found, j).s > get(found, j - 1).e + 1 and {low.format('j')} > {high.format('(j - 1)')} + 1"
    d = d.withColumn("at", F.expr(f"if(size(found) > 0, filter(sequence(0, size(found) - 1), j -> j = 0 or ({apart})), null)"))
    d = d.withColumn("starts", F.expr(f"transform(at, j -> {low.format('j')})"))
    d = d.withColumn("ends", F.expr(f"transform(at, (j, i) -> {high.format('(coalesce(get(at, i + 1), size(found)) - 1)')})"))
    d = d.withColumn("cut", F.expr("if(size(starts) > 0, transform(starts, (x, j) -> named_struct('s', x, 'e', get(ends, j))), null)"))
    d = d.withColumn("units", F.when(F.col("cut").isNotNull(), units_of(F.col("text")))).withColumn("lead", F.expr("size(units) - n"))
    part = "array_join(slice(units, if(j = 0, 1, lead + get(cut, j - 1).e + 1), if(j = size(cut), size(units), lead + get(cut, j).s - 1) - if(j = 0, 0, lead + get(cut, j - 1).e)), '')"
    kept = F.expr(f"array_join(transform(sequence(0, size(cut)), j -> {part}), '')")
    text = F.when(F.col("cut").isNull(), F.col("row.text")).otherwise(kept)
    told = F.struct(text.alias("text"), F.when(F.col("cut").isNotNull(), F.col("n")).alias("n_units"), F.coalesce("cut", none).alias("runs"))
    # as the one element of an array: a filter on what is told is not moved below it, where all would be worked out again
    d = d.select("row", F.explode(F.array(told)).alias("told"))
    own_columns = [F.col("told.text" if c == "text" else f"row.`{c}`").alias(c) for c in plain.columns]
    return untouched.union(d.select(*own_columns, "told.n_units", "told.runs"))

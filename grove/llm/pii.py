"""Operator 1, information-theoretic sanitisation, in DataFrame functions alone.

Protected entities are the values that the base patterns find (e-mail and IP addresses, card and phone numbers). All terms
of the texts that hold an entity, outside base spans, are measured against the corpus: with counts n(e, t), n(e), n(t) and N,

    PMI(e; t) = log2(N n(e, t) / (n(e) n(t)))        IC(e) = log2(N / n(e))        disclosure = PMI / IC  (at most 1)

A term whose meeting with the entity is no chance is generalised in the entity's documents from a disclosure of GENERALISE
on and removed from REMOVE on: it tells the entity nearly as well as the entity itself would. Chance is ruled out where a
bound on the hypergeometric tail (Hoeffding), times the number of terms tested for the entity, is at most CHANCE; there is no
least number of texts, so in a large corpus a single short text may do, and in a small one it may not. Counts are of
different texts: copies count once.

The base spans always stay; term spans come besides. Null texts are empty texts. Rows that repeat a text
count as one in the statistics and get a result row each. Ties don't arise: spans have a full order, start and
then kind. Very long texts are searched whole: offsets and prefix maxima come from scans by doubling, and texts are put
together from blocks, so that the work grows nearly as the text and its matches do. An empty table gives no rows. Of the
input only doc_id and text are read; sanitise() returns all its columns, which it carries as one, so that no name clashes.
Texts are told apart by 128 bits of a digest.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Chance that some term of an entity passes without any tie to it.
CHANCE = 0.01
GENERALISE = 0.9
REMOVE = 0.97
#: Up to so many rows (each some tens of bytes) a table may be broadcast; beyond that it is joined by key.
BROADCAST_ROWS = 50_000
BROADCAST_BYTES = 32 << 20
#: Code points of a block of a text.
BLOCK = 8192

KINDS = ("email", "ip", "card", "phone")
#: The base patterns, with possessive repeats (nothing after them could use what they give back) and anchored so that a
#: search that fails isn't tried again from each later character of the same run; \G lets a match start where one ended.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_TERM = r"[\p{L}\p{N}]{3,}"


def _sql_text(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _valid(kind: str, x: str) -> str:
    digits = f"regexp_replace({x}, '[^0-9]', '')"
    return {
        "email": "true",
        "ip": f"forall(split({x}, '[.]'), p -> length(regexp_replace(p, '^0+', '')) <= 3 and coalesce(try_cast(p as decimal(38,0)), 0) <= 255)",
        "card": f"length({x}) >= 12 and length({digits}) between 12 and 19 and luhn_check({digits})",
        "phone": f"length({x}) >= 10 and length({digits}) between 9 and 15",
    }[kind]


def _gate(kind: str, t: str) -> str:
    return {"email": f"contains({t}, '@')", "ip": f"contains({t}, '.')", "card": "true", "phone": f"contains({t}, '+')"}[kind]


def _scan(numbers: str, join: str) -> str:
    """SQL for the inclusive prefix sums ("+") or maxima ("greatest") of an array of integers, by doubling."""
    earlier = "case when i >= shiftleft(1, k) then a[i - shiftleft(1, k)] else 0 end"
    step = f"x + {earlier}" if join == "+" else f"greatest(x, {earlier})"
    return f"aggregate(sequence(0, cast(ceil(log2(greatest(size({numbers}), 1))) as int)), {numbers}, (a, k) -> transform(a, (x, i) -> {step}))"


_NO_NUMBERS, _NO_TEXTS, _NO_SPANS = (f"cast(array() as array<{t}>)" for t in ("int", "string", "struct<start:int,k:int,end:int,m:string>"))


def _with_spans(rows: DataFrame, text: str, kinds: list[tuple], out: str) -> DataFrame:
    """rows and, as out, the spans of all kinds: array of (start, k, end, m) in code points, end exclusive, in order.

    A kind is its name, its rank, and SQL for the pattern, for whether it can match, and for whether a match counts.
    """
    held = [F.col(f"`{c}`") for c in rows.columns]
    rows = rows.selectExpr("*", *[f"case when {gate} then regexp_extract_all({text}, {pattern}, 0) else {_NO_TEXTS} end as _m_{n}" for n, _, pattern, gate, _ in kinds])
    rows = rows.selectExpr("*", *[f"exists(_m_{n}, m -> {counts('m')}) as _v_{n}" for n, _, _, _, counts in kinds])
    rows = rows.selectExpr("*", *[f"case when _v_{n} then split({text}, {pattern}, -1) else {_NO_TEXTS} end as _p_{n}" for n, _, pattern, _, _ in kinds])
    gaps = "transform(_m_{n}, (m, i) -> length(_p_{n}[i]) + case when i > 0 then length(_m_{n}[i - 1]) else 0 end)"
    # named twice, the pieces are an array that is made once, not an expression within the function over the matches
    rows = rows.selectExpr("*", *[f"case when _v_{n} and size(_p_{n}) > 0 then {gaps.format(n=n)} else {_NO_NUMBERS} end as _d_{n}" for n, *_ in kinds])
    rows = rows.selectExpr("*", *[f"case when _v_{n} then {_scan(f'_d_{n}', '+')} else {_NO_NUMBERS} end as _s_{n}" for n, *_ in kinds])
    place = "transform(_m_{n}, (m, i) -> named_struct('start', _s_{n}[i], 'k', {k}, 'end', _s_{n}[i] + length(m), 'm', m))"
    each = [f"case when _v_{n} then filter({place.format(n=n, k=k)}, s -> {counts('s.m')}) else {_NO_SPANS} end" for n, k, _, _, counts in kinds]
    return rows.select(*held, F.expr(f"array_sort(concat({', '.join(each)}))").alias(out))


def base_spans(docs: DataFrame, text: str = "_t") -> DataFrame:
    """docs and _spans: array of (start, k, end, m) of all kinds, in order."""
    return _with_spans(docs, text, [(k, r, _sql_text(PATTERNS[k]), _gate(k, text), lambda x, k=k: _valid(k, x)) for r, k in enumerate(KINDS)], "_spans")


def _piece(start: str, size: str) -> str:
    """SQL for a part of the text whose blocks are _blk."""
    a, z = f"(({start}) div {BLOCK})", f"(({start} + {size} - 1) div {BLOCK})"
    within = f"substring(_blk[{a}], ({start}) % {BLOCK} + 1, {size})"
    across = f"concat(substring(_blk[{a}], ({start}) % {BLOCK} + 1), array_join(slice(_blk, {a} + 2, greatest({z} - {a} - 1, 0)), ''), substring(_blk[{z}], 1, ({start} + {size} - 1) % {BLOCK} + 1))"
    within, across = (x.replace(a, f"cast({a} as int)").replace(z, f"cast({z} as int)") for x in (within, across))
    return f"case when {size} <= 0 then '' when {a} = {z} then {within} else {across} end"


def rebuilt(rows: DataFrame, spans: str, filler: str, out: str) -> DataFrame:
    """rows and out: _t with filler in the place of each span that doesn't end within those before it; filler is SQL over s, the span, and {b}, where those end."""
    held = [F.col(f"`{c}`") for c in rows.columns]
    some = f"size({spans}) > 0"
    ends = f"transform({spans}, (s, i) -> case when i > 0 then {spans}[i - 1].end else 0 end)"
    rows = rows.selectExpr("*", f"case when {some} then {ends} else {_NO_NUMBERS} end as _e")
    blocks = f"transform(sequence(0, cast((length(_t) - 1) div {BLOCK} as int)), j -> substring(_t, j * {BLOCK} + 1, {BLOCK}))"
    rows = rows.selectExpr("*", f"case when {some} then {_scan('_e', 'greatest')} else {_NO_NUMBERS} end as _b", f"case when {some} then {blocks} else {_NO_TEXTS} end as _blk")
    rows = rows.selectExpr("*", f"case when {some} then greatest(_b[size(_b) - 1], {spans}[size({spans}) - 1].end) else 0 end as _last")
    part = f"case when s.end <= _b[i] then '' else concat({_piece('_b[i]', '(s.start - _b[i])')}, {filler.replace('{b}', '_b[i]')}) end"
    whole = f"concat(array_join(transform({spans}, (s, i) -> {part}), ''), {_piece('_last', '(length(_t) - _last)')})"
    return rows.select(*held, F.expr(f"case when {some} then {whole} else _t end").alias(out))


def masked(rows: DataFrame) -> DataFrame:
    """rows and _masked: _t with spaces in the place of what is in _spans, so that all else stands where it stood."""
    return rebuilt(rows, "_spans", "repeat(' ', s.end - greatest(s.start, {b}))", "_masked")


def _named(spans: str, kinds: tuple[str, ...]) -> str:
    names = "array(" + ", ".join(f"'{k}'" for k in kinds) + ")"
    return f"array_join(transform({spans}, s -> concat_ws(':', element_at({names}, s.k + 1), s.start, s.end)), ',')"


def _words(column: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(column), F.lit(_TERM), F.lit(0)))


def _terms(rows: DataFrame, *carried: str) -> DataFrame:
    """A row for each different term outside the spans, from rows with _masked. (An outer explosion, so that none is worked out twice for a filter.)"""
    return rows.select(F.explode_outer(_words(F.col("_masked"))).alias("term"), *carried).where("term is not null")


def _small(df: DataFrame) -> DataFrame:
    """A stored table, marked for broadcast only if it has few rows and bytes."""
    few = df.limit(BROADCAST_ROWS + 1).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length(F.to_json(F.struct("*")))), F.lit(0)).alias("bytes")).first()
    return F.broadcast(df) if few["n"] <= BROADCAST_ROWS and few["bytes"] <= BROADCAST_BYTES else df


def entities(held: DataFrame) -> DataFrame:
    """_uid, _h and entity, each once, from rows of _uid, _h and _spans."""
    one = held.select("_uid", "_h", F.explode("_spans").alias("s"))
    return one.select("_uid", "_h", F.concat_ws(":", F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("s.k") + 1), F.lower("s.m")).alias("entity")).distinct()


def disclosing_terms(texts: DataFrame, held: DataFrame, found: DataFrame) -> DataFrame:
    """entity, term, disclosure and action. texts has _h and _t; held are with_entities(texts), found is entities(held); both stored."""
    different = cut(texts.groupBy("_h").agg(F.count("*").alias("rows")))
    n = float(different.count())
    listed = cut(masked(held.dropDuplicates(["_h"])).select("_h", _words(F.col("_masked")).alias("terms")))
    own = found.select("_h", "entity").distinct()
    of_entity = own.join(listed.select("_h", F.size("terms").alias("n")), "_h").groupBy("entity").agg(F.count("*").alias("n_e"), F.sum("n").alias("tested"))
    # disclosure >= GENERALISE means n(t) <= n(e, t) (N / n(e)) ** (1 - GENERALISE), and n(e, t) <= n(e): more frequent terms
    # need not be counted by entity
    most = F.pow("n_e", F.lit(GENERALISE)) * F.pow(F.lit(n), F.lit(1 - GENERALISE)) * (1 + 1e-9)
    own = cut(own.join(of_entity.where(F.col("n_e") < n), "entity").withColumn("most", most))
    of_text = own.groupBy("_h").agg(F.max("most").alias("most"))
    terms = listed.select("_h", F.explode("terms").alias("term"))
    # a term's texts with entities are some of its texts: what those alone rule out needs no count over the corpus
    some = terms.groupBy("term").agg(F.count("*").alias("n_some"))
    terms = cut(terms.join(of_text, "_h").join(some, "term").where(F.col("n_some") <= F.col("most")).select("_h", "term"))
    wanted = cut(terms.select("term").distinct())
    # rows by term, aggregated before anything is exchanged, less the rows that are further copies of a text
    rows = _terms(masked(base_spans(texts))).groupBy("term").agg(F.count("*").alias("rows"))
    copied = cut(different.where(F.col("rows") > 1))
    copies = masked(base_spans(texts.select("_h", "_t").join(_small(copied), "_h").dropDuplicates(["_h"])))
    further = _terms(copies, "rows").groupBy("term").agg(F.sum(F.col("rows") - 1).alias("further"))
    counted = rows.join(wanted, "term").join(further, "term", "left")
    of_term = counted.select("term", (F.col("rows") - F.coalesce("further", F.lit(0))).alias("n_t"))
    pairs = terms.join(of_term, "term").join(own, "_h").where(F.col("n_t") <= F.col("most"))
    pairs = pairs.groupBy("entity", "term").agg(F.count("*").alias("both"), *[F.max(c).alias(c) for c in ("n_e", "n_t", "tested")])
    disclosure = F.log2(F.lit(n) * F.col("both") / (F.col("n_e") * F.col("n_t"))) / F.log2(F.lit(n) / F.col("n_e"))

    def tail(drawn: str, marked: str) -> Column:  # logarithm of the bound, for above the mean
        a, p = F.col("both") / F.col(drawn), F.col(marked) / F.lit(n)
        rest = F.when(F.col("both") < F.col(drawn), (1 - a) * F.log((1 - a) / (1 - p))).otherwise(F.lit(0.0))
        return -F.col(drawn) * (a * F.log(a / p) + rest)

    chance = F.least(tail("n_t", "n_e"), tail("n_e", "n_t")) + F.log("tested")
    action = F.when(F.col("disclosure") >= REMOVE, "remove").otherwise("generalise")
    passed = pairs.withColumn("disclosure", disclosure).where((F.col("disclosure") >= GENERALISE) & (chance <= math.log(CHANCE)))
    return passed.select("entity", "term", "disclosure", action.alias("action"))


def terms_of_documents(texts: DataFrame, held: DataFrame) -> DataFrame:
    """_uid, _removed and _generalised: the disclosing terms of the entities in it (stored). held: with_entities(texts)."""
    found = cut(entities(held))
    marks = cut(disclosing_terms(texts, held, found))
    hit = found.select("_uid", "entity").join(_small(marks), "entity")
    of_doc = hit.groupBy("_uid").agg(F.collect_set(F.when(F.col("action") == "remove", F.col("term"))).alias("_removed"), F.collect_set("term").alias("_all"))
    return cut(of_doc.select("_uid", "_removed", F.array_except("_all", "_removed").alias("_generalised")))


def with_term_spans(rows: DataFrame) -> DataFrame:
    """rows (_t, _spans, _removed, _generalised) and _terms: array of (start, k, end, m), k 4 or 5, clear of the base spans."""
    held = [F.col(f"`{c}`") for c in rows.columns]
    word = lambda c: f"concat('(?iu)(?<![\\\\p{{L}}\\\\p{{N}}])(?:', array_join({c}, '|'), ')(?![\\\\p{{L}}\\\\p{{N}}])')"
    kinds = [(c, k, word(f"_{c}"), f"size(_{c}) > 0", lambda x: "true") for c, k in (("removed", 4), ("generalised", 5))]
    return _with_spans(masked(rows), "_masked", kinds, "_terms").select(*held, "_terms")


def _where_any(rows: DataFrame, array: str) -> DataFrame:
    """The rows whose array isn't empty. The partition's number keeps the optimizer from working the array out once more below, for the filter alone."""
    return rows.withColumn("_once", F.spark_partition_id()).where((F.size(array) > 0) & (F.col("_once") >= 0)).drop("_once")


def with_entities(texts: DataFrame) -> DataFrame:
    """_uid, _h, _t and _spans of the documents that have base spans, each once (stored)."""
    return cut(_where_any(base_spans(texts), "_spans").select("_uid", "_h", "_t", "_spans").dropDuplicates(["_uid"]))


def keyed(rows: DataFrame, doc_id: str) -> DataFrame:
    """rows with _h, a digest of _t, and _uid, one of that and the document's id (SQL)."""
    digest = lambda c: F.unhex(F.md5(c))
    rows = rows.withColumn("_h", digest(F.col("_t").cast("binary")))
    return rows.withColumn("_uid", digest(F.concat(F.coalesce(F.expr(doc_id).cast("string"), F.lit("")), F.lit(":"), F.hex("_h")).cast("binary")))


def spans_of(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, _spans (base) and _terms of every row."""
    texts = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("_t"))
    texts = keyed(texts, "doc_id")
    held = with_entities(texts)
    chosen = terms_of_documents(texts, held)
    terms = cut(_where_any(with_term_spans(held.join(_small(chosen), "_uid")), "_terms").select("_uid", "_terms"))
    return base_spans(texts).select("doc_id", "_uid", "_spans").join(_small(terms), "_uid", "left").select("doc_id", "_spans", "_terms")


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term."""
    rows = spans_of(docs, doc_id, text)
    kinds = (*KINDS, "term", "term")
    counts = [F.expr(f"cast(size(filter(_spans, s -> s.k = {r})) as long)").alias(f"n_{k}") for r, k in enumerate(KINDS)]
    every = f"array_sort(concat(_spans, coalesce(_terms, {_NO_SPANS})))"
    return rows.select(
        "doc_id", *counts, F.sha2(F.expr(_named("_spans", kinds)), 256).alias("base_sha256"), F.expr(_named(every, kinds)).alias("spans"),
        F.expr("cast(coalesce(size(_terms), 0) as long)").alias("n_term"),
    )


def sanitise(docs: DataFrame) -> DataFrame:
    """The documents with their columns; in text base spans become [EMAIL] and so on, disclosing terms go or become [TERM]; n_chars to match."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_in")).withColumn("_t", F.coalesce(F.col("_in.text").cast("string"), F.lit("")))
    rows = keyed(rows, "cast(_in.doc_id as long)")
    texts = rows.select("_uid", "_h", "_t")
    chosen = terms_of_documents(texts, with_entities(texts))
    joined = base_spans(rows.join(_small(chosen), "_uid", "left"))
    joined = joined.withColumns({c: F.coalesce(F.col(c), F.expr(_NO_TEXTS)) for c in ("_removed", "_generalised")})
    marked = with_term_spans(joined).withColumn("_all", F.array_sort(F.concat("_spans", "_terms")))
    done = rebuilt(marked, "_all", "element_at(array('[EMAIL]', '[IP]', '[CARD]', '[PHONE]', '', '[TERM]'), s.k + 1)", "_new")

    def column(c: str) -> Column:
        own = F.col(f"_in.`{c}`")
        if c == "text":
            own = F.when(own.isNull(), own).otherwise(F.col("_new"))
        elif c == "n_chars":
            own = F.when(F.size("_all") > 0, F.char_length("_new")).otherwise(own).cast(docs.schema[c].dataType)
        return own.alias(c)

    return done.select(*[column(c) for c in docs.columns])


def op1_pii(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return find(table(spark, sf_dir, "documents"))

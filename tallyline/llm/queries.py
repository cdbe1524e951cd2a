"""One query per operator of this subpackage, over whole tables, and its SQL where SQL can express it."""

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.llm.conversation_trie import prefix_trie
from tallyline.llm.exact_dedup import exact_groups
from tallyline.llm.lexical_search import search
from tallyline.llm.line_dedup import drop_repeated_lines
from tallyline.llm.lm_scoring import score_texts
from tallyline.llm.mixing import mix
from tallyline.llm.near_dedup import near_groups
from tallyline.llm.packing import byte_bpe, pack, pieces
from tallyline.llm.pii import KINDS, find_pii
from tallyline.llm.quality_classifier import STATISTICS, document_statistics, fit, score
from tallyline.llm.quality_rules import FULL_POLICY, apply_policy, ledger
from tallyline.llm.secrets import STRONG, WEAK, find_secrets
from tallyline.llm.warc import read_records, write_bundles
from tallyline.session import scratch_path, shared


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _remainder(divisor: int) -> Column:
    """crc32 of the identifier's digits, modulo a divisor."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % divisor


def tokenizer(path: str | None = None):
    """Loader of the public byte-level tokenizer, by default the installed one: its special tokens are those of the JSON file,
    its merges are read from the rank file beside it, which a faster library takes and which gives the same ids."""
    import public_tokenizers

    path = path or public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as file:
        special = {token["content"]: token["id"] for token in json.load(file)["added_tokens"]}
    return byte_bpe(path.removesuffix(".json") + ".tiktoken", public_tokenizers.PATTERN, special)


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_texts(_table(spark, sf_dir, "documents"), _remainder(10) != 0)
    return scored.select(
        "doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes",
        (-F.col("score") / F.log10(F.lit(2.0)) / F.nullif("n_bytes", F.lit(0))).alias("bits_per_byte"),
    )


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts without repeated lines."""
    return drop_repeated_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack(pieces(_table(spark, sf_dir, "documents"), tokenizer()))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three words in a row, linked from 85 in 100."""
    found = near_groups(_table(spark, sf_dir, "documents"), width=3, percent=85)
    return found.select(
        "doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")
    )


#: Target weights of the query: by domain, and by language in one domain.
MIX_WEIGHTS = {("d0",): 3, ("d1",): 2, ("d2",): 1, ("d0", "en"): 1, ("d0", "fr"): 2}
MIX_BUDGET, MIX_EPOCHS, MIX_SEED = 1.5, 4, 7


def domain() -> Column:
    """The test tables have no domain: three are made of the source's number."""
    return F.concat(F.lit("d"), (F.regexp_extract("source", "([0-9]+)$", 1).try_cast("int") % 3).cast("string"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = {"domain": domain(), "lang": F.col("lang"), "source": F.col("source")}
    found = mix(_table(spark, sf_dir, "documents"), levels, MIX_BUDGET, MIX_WEIGHTS, MIX_EPOCHS, MIX_SEED)
    return found.drop("text_md5")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(_table(spark, sf_dir, "documents"), keep="largest")


def _span_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined in the order given."""
    text = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(text, ",")


def _of_kind(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def _sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _in_order(spans: Column, *keys: Callable[[Column], Column]) -> Column:
    """Sorted by the keys, which become the leading fields of the structs compared."""
    keyed = F.transform(spans, lambda s: F.struct(*[key(s).alias(f"k{i}") for i, key in enumerate(keys)], s.alias("s")))
    return F.transform(F.array_sort(keyed), lambda k: k["s"])


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digest of the plain spans; ``spans`` has the hidden ones too."""
    found = find_pii(_table(spark, sf_dir, "documents"))
    rank = lambda s: F.array_position(F.array(*map(F.lit, KINDS)), s["kind"])
    everything = _in_order(F.concat("plain", "hidden"), rank, lambda s: s["start"], lambda s: s["end"])
    return found.select(
        "doc_id",
        *[_of_kind("plain", kind).alias(f"n_{kind}") for kind in KINDS],
        _sha256(_span_text(F.col("plain"))).alias("base_sha256"),
        _span_text(everything).alias("spans"),
        F.size("hidden").cast("long").alias("n_hidden"),
    )


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digest of the strong spans; ``spans`` has the linked weak ones too."""
    found = find_secrets(_table(spark, sf_dir, "documents"))
    rank = lambda s: F.array_position(F.array(*map(F.lit, STRONG + WEAK)), s["kind"])
    everything = _in_order(F.concat("strong", "linked"), lambda s: s["start"], rank, lambda s: s["end"])
    return found.select(
        "doc_id",
        *[_of_kind("strong", kind).alias(f"n_{kind}") for kind in STRONG],
        _sha256(_span_text(F.col("strong"))).alias("base_sha256"),
        _span_text(everything).alias("spans"),
        F.size("linked").cast("long").alias("n_linked"),
    )


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = apply_policy(ledger(_table(spark, sf_dir, "documents")), FULL_POLICY)
    base = F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), "kept", "failures", "policy",
    )


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shared(document_statistics(_table(spark, sf_dir, "documents")))
    labels = _table(spark, sf_dir, "labels").select("doc_id", "quality")
    model = fit(rows.filter(_remainder(4) != 2).join(labels, "doc_id"))
    return score(rows, model).select(
        "doc_id", (_remainder(4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(_table(spark, sf_dir, "conversations"))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written to the shared folder, then read back."""
    path = scratch_path(spark, "warc")
    write_bundles(_table(spark, sf_dir, "pages"), path)
    return read_records(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_line_dedup": op2_line_dedup,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_near_dedup": op4_near_dedup,
    "op5_mixing": op5_mixing,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_pii": op7_pii,
    "op8_secrets": op8_secrets,
    "op9_quality_rules": op9_quality_rules,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_lexical_search": op11_lexical_search,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_warc": op13_warc,
}



def _level_sql(levels: list[str], weights: dict[tuple[str, ...], int]) -> str:
    """SQL steps that share each parent's budget among its children; they read n0, n1, ... and make b1, b2, ..."""
    depth, here, parents = len(levels), ", ".join(levels), ", ".join(levels[:-1])
    cases = "".join(
        "when " + " and ".join(f"{c} = '{v}'" for c, v in zip(levels, path)) + f" then {w} "
        for path, w in weights.items() if len(path) == depth
    )
    family = f"partition by {parents}" if parents else ""
    given = f"join b{depth - 1} using ({parents})" if parents else "cross join b0"
    return f"""
        w{depth} as (
            select {here}, sum(capacity)::hugeint as capacity, any_value(budget) as given,
                   {"case " + cases + "else 1 end" if cases else "1"} as w
            from leaves {given} group by {here}
        ),
        f{depth} as (
            select *, capacity * sum(w) over (o rows between current row and unbounded following)
                      <= (given - coalesce(sum(capacity) over (o rows between unbounded preceding and 1 preceding), 0)) * w as whole
            from w{depth} window o as ({family} order by capacity::double / w, {levels[-1]})
        ),
        b{depth} as (
            select {here}, case when whole then capacity else
                       ((given - sum(case when whole then capacity else 0 end) over ({family})) * w)
                       // sum(case when whole then 0 else w end) over ({family}) end::hugeint as budget
            from f{depth}
        )"""


_MIX_SQL = f"""
    with docs as (
        select doc_id, coalesce('d' || (try_cast(regexp_extract(source, '([0-9]+)$', 1) as int) % 3), '') as domain,
               coalesce(lang, '') as lang, coalesce(source, '') as source, md5(coalesce(text, '')) as text_md5,
               len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as n_tokens
        from documents
    ),
    totals as (select domain, lang, source, sum(n_tokens) as total from docs group by all),
    leaves as (select *, total * {MIX_EPOCHS} as capacity from totals),
    b0 as (select least(sum(capacity), floor({MIX_BUDGET} * sum(total)))::hugeint as budget from leaves),
    {_level_sql(["domain"], MIX_WEIGHTS)}, {_level_sql(["domain", "lang"], MIX_WEIGHTS)},
    {_level_sql(["domain", "lang", "source"], MIX_WEIGHTS)},
    plan as (
        select domain, lang, source, budget::bigint as leaf_budget,
               case when total > 0 then (budget // total)::bigint else 0 end as epochs,
               case when total > 0 then (budget % total)::bigint else 0 end as rest
        from totals join b3 using (domain, lang, source)
    ),
    placed as (
        select *, md5('{MIX_SEED}|' || (epochs + 1) || '|' || coalesce(doc_id::varchar, '') || '|' || text_md5) as place
        from docs join plan using (domain, lang, source)
    )
    select doc_id, domain, lang, source, n_tokens, leaf_budget, epochs,
           greatest(0, least(n_tokens, rest - coalesce(sum(n_tokens) over (
               partition by domain, lang, source order by place rows between unbounded preceding and 1 preceding), 0)))::bigint as last_tokens
    from placed
"""

_SEARCH_SQL = """
    with d as (
        select row_number() over () as r, doc_id, regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as ts
        from documents
    ),
    facts as (select count(*) filter (len(ts) > 0) as n, sum(len(ts))::bigint as l from d),
    tf as (select r, t, count(*) as tf from (select r, unnest(ts) as t from d) group by all),
    w as (select t, floor(1000 * ln((2 * n + 2)::double / (2 * count(*) + 1)))::bigint as w from tf cross join facts group by t, n),
    asked as (
        select item_id, t, count(*) as times from (
            select item_id, unnest(regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as t
            from benchmark
        ) group by all
    ),
    scored as (
        select item_id, r, doc_id,
               sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * len(ts) * n) // l))))::bigint as score
        from asked join tf using (t) join w using (t) join d using (r) cross join facts group by all
    )
    select item_id, row_number() over (partition by item_id order by score desc, doc_id nulls last)::int as rank, doc_id, score
    from scored where score > 0 qualify rank <= 20
"""

_TRIE_SQL = """
    with own as (
        select conv_id as c, row_number() over (partition by conv_id order by turn nulls first, s) as j, s, bytes
        from (
            select *, strlen(coalesce(text, '')) as bytes,
                   sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) as s
            from conversations where conv_id is not null
        )
    ),
    conv as (
        -- crc32 of the digits: -1 stands for one step of a bit.
        select c, count(*) as n, list_reduce(
            list_prepend(4294967295, flatten(list_transform(string_split(c::varchar, ''), lambda d: [ascii(d), -1, -1, -1, -1, -1, -1, -1, -1])))::bigint[],
            lambda a, x: case when x >= 0 then xor(a, x) else xor(a >> 1, (a & 1) * 3988292384) end) as crc
        from own group by c
    ),
    plan as (
        select a.c, a.c - a.c % 5 as base, xor(a.crc, 4294967295) % 9 as h, least(xor(a.crc, 4294967295) % 9, coalesce(b.n, 0)) as k
        from conv a left join conv b on b.c = a.c - a.c % 5
    ),
    turns as (
        select p.c, o.j as d, s, bytes from plan p join own o on o.c = p.base and o.j <= p.h
        union all
        select p.c, o.j - h + k, s, bytes from plan p join own o on o.c = p.c and o.j > p.h
    ),
    rows as (
        select c, d, sha256(string_agg(s, '' order by d) over (partition by c order by d)) as key, bytes from turns
        union all
        select c, 0, '', 0 from plan
    ),
    ends as (select c, max(d) as d from rows group by c),
    nodes as (
        select d, key, min(r.c) as c, count(*) as n_convs, any_value(bytes) as bytes, count(e.c) as n_ends,
               sha256(coalesce(string_agg(e.c::varchar, ',' order by e.c), '')) as ends_sha256
        from rows r left join ends e using (c, d) group by d, key
    ),
    sums as (
        select r.d, r.key, sum((u.n_ends = u.n_convs)::int)::bigint as n_leaves, sum((u.n_convs - 1) * u.bytes)::bigint as saved_tokens
        from nodes u join rows r on r.c = u.c and r.d <= u.d group by r.d, r.key
    ),
    up as (select n.d, n.key, p.key as parent from nodes n join rows p on p.c = n.c and p.d = n.d - 1),
    kids as (select d - 1 as d, parent as key, count(*) as n_children from up group by d - 1, parent)
    select n.c as conv_id, n.d as depth, p.c as parent_conv_id, n.n_convs, coalesce(n_children, 0) as n_children, n_leaves, saved_tokens, n.ends_sha256
    from nodes n join sums using (d, key) left join up using (d, key) left join nodes p on p.key = up.parent and p.d = n.d - 1
         left join kids on kids.d = n.d and kids.key = n.key
"""

_WARC_SQL = """
    with p as (select page_id, coalesce(html, '') as html from pages),
    seen as (
        select page_id, strlen(html) as payload_bytes, sha1(html) as hex, min(page_id) over same as least,
               row_number() over (partition by html order by page_id nulls last) = 1 as leads
        from p window same as (partition by html)
    )
    select page_id, payload_bytes,
           -- Five hexadecimal digits make four of base 32.
           array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
               ((('0x' || substr(hex, 5 * (i // 4) + 1, 5))::bigint >> (15 - 5 * (i % 4))::bigint) & 31)::bigint + 1, 1)), '') as payload_digest,
           case when leads then 'response' else 'revisit' end as record_type, case when not leads then least end as refers_to
    from seen
"""

ORACLES = {
    "op11_lexical_search": _SEARCH_SQL,
    "op12_prefix_trie": _TRIE_SQL,
    "op13_warc": _WARC_SQL,
    "op5_mixing": _MIX_SQL,
    "op6_exact_dedup": """
        with t as (select doc_id, coalesce(text, '') as text from documents)
        select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size,
               doc_id is not distinct from max(doc_id) over w as kept, sha256(text) as text_sha256
        from t window w as (partition by text)
    """,
}

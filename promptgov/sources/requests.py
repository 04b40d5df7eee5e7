"""Chat requests: from raw JSON bodies, or assembled from a table of turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptgov.functions.matching import pinned
from promptgov.functions.text import LONG_S

MAX_BODY_BYTES = 10 * 1024 * 1024

MESSAGES = "array<struct<role:string,content:string>>"


def _field(fields: str, name: str) -> str:
    """SQL for a member of a JSON object; names match without regard to case."""
    folded = f"replace(lower(e.key), '{LONG_S}', 's')"
    return f"try_element_at(filter(map_entries({fields}), e -> {folded} = '{name}'), -1).value"


def _is_text(value: str) -> str:
    """SQL: a string, a JSON null, or missing."""
    return f"({value} IS NULL OR is_variant_null({value}) OR schema_of_variant({value}) = 'STRING')"


def _text(value: str) -> str:
    return f"coalesce(try_variant_get({value}, '$', 'string'), '')"


def parse_requests(df: DataFrame, body: str = "body") -> DataFrame:
    """Add `valid`, `model`, `messages` and `prompt` parsed from the JSON body.

    A body is valid if it is one JSON value, an object or null, whose model, role
    and content are strings and whose messages are a list of objects; each may be
    null or missing. Other members are ignored, and the last of several members
    with one name counts. Long bodies are parsed too; the gate turns them away by itself.

    The JSON parser stops at the end of the first value. So the body is parsed
    inside a list that ends with the hash of the body: anything after the first
    value makes the list invalid, longer, or end early.
    """
    # Needed for "the last one counts"; without it such a body would be refused.
    df.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    kept = [c for c in df.columns if c not in ("valid", "model", "messages", "prompt")]
    text, tag = F.col(body), F.xxhash64(body)
    listed = F.concat(F.lit("["), text, F.lit(","), tag.cast("string"), F.lit("]"))
    parsed = (
        df.withColumn("__list", F.try_parse_json(listed))
        .withColumn("__list", F.expr("try_cast(__list AS array<variant>)"))
        .withColumn("__tag", tag)
        .withColumn("__root", F.expr(
            "CASE WHEN size(__list) = 2 AND try_variant_get(__list[1], '$', 'bigint') = __tag"
            " THEN __list[0] END"))
        .withColumn("__members", F.expr("try_cast(__root AS map<string, variant>)"))
        .withColumn("__model", F.expr(_field("__members", "model")))
        .withColumn("__messages", F.expr(_field("__members", "messages")))
        .withColumn("__items", F.expr("try_cast(__messages AS array<variant>)"))
        .withColumn("__parts", F.expr(f"""
            transform(__items, x -> named_struct('ok', is_variant_null(x), 'members',
                      try_cast(x AS map<string, variant>)))"""))
        .withColumn("__parts", F.expr(f"""
            transform(__parts, p -> named_struct('ok', p.ok OR p.members IS NOT NULL,
                      'role', {_field("p.members", "role")},
                      'content', {_field("p.members", "content")}))"""))
    )
    ok = F.expr(f"""
        (is_variant_null(__root) OR __members IS NOT NULL)
        AND {_is_text('__model')}
        AND (__messages IS NULL OR is_variant_null(__messages) OR __items IS NOT NULL)
        AND coalesce(forall(__parts, p -> p.ok AND {_is_text('p.role')} AND {_is_text('p.content')}),
                     true)""")
    messages = F.expr(f"""
        coalesce(transform(__parts, p -> named_struct('role', {_text('p.role')},
                           'content', {_text('p.content')})),
                 CAST(array() AS {MESSAGES}))""")
    checked = parsed.withColumn("valid", F.coalesce(ok, F.lit(False)))
    request = F.struct(
        "valid",
        F.when(F.col("valid"), F.expr(_text("__model"))).alias("model"),
        F.when(F.col("valid"), messages).alias("messages"),
    )
    found = pinned(checked, kept, request, "__request")
    return found.select(
        *kept, "__request.valid", "__request.model", "__request.messages",
        prompt_of(F.col("__request.messages")).alias("prompt"))


def prompt_of(messages: Column) -> Column:
    """The user messages in order, each followed by a newline."""
    lines = F.transform(
        F.filter(messages, lambda m: m["role"] == "user"),
        lambda m: F.concat(m["content"], F.lit("\n")),
    )
    return F.array_join(lines, "")


def requests_from_turns(
    turns: DataFrame, key: str, order: str, role: str = "role", text: str = "text",
    model: str = "", max_body_bytes: int | None = None,
) -> DataFrame:
    """One request per `key`: a JSON body holding its turns in order, and `body_bytes`.

    Where `max_body_bytes` is given, conversations whose texts are longer are found first
    from their summed sizes and get a NULL body.
    """
    own_bytes = F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
    size = turns.groupBy(key).agg(F.sum(own_bytes).alias("body_bytes"))
    limit = F.lit(max_body_bytes).cast("long")  # without one, no size is over it
    oversize = size.filter(F.col("body_bytes") > limit)
    turn = F.struct(F.col(order).alias("at"), F.col(role).alias("role"), F.col(text).alias("content"))
    bodies = (
        turns.join(oversize.select(key), key, "left_anti")
        .groupBy(key)
        .agg(F.sort_array(F.collect_list(turn)).alias("turns"))
        .select(key, F.to_json(F.struct(
            F.lit(model).alias("model"),
            F.transform("turns", lambda t: F.struct(t["role"].alias("role"),
                                                    t["content"].alias("content"))).alias("messages"),
        )).alias("body"))
        .withColumn("body_bytes", F.octet_length("body").cast("long"))
    )
    return bodies.unionByName(
        oversize.select(key, F.lit(None).cast("string").alias("body"), "body_bytes"))

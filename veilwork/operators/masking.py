"""Detecting, masking and restoring over tables of texts.

Detection and redaction are projections: nothing is shuffled. Numbered tokens need shuffles of the values met to number them; then
they are brought back to their texts, by a broadcast while they are few, else by a join that moves the texts once.

What is done to a text depends on its session and on the text alone, so pieces and values find their way back by these two (a text
by its digest). Neither order nor session need tell rows apart or be there: a null session is a session like any other, rows alike
are masked alike, and texts of equal order are met by their digests, null orders first.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilwork.config import Detect
from veilwork.functions import tokens as T
from veilwork.functions.spans import SPAN, detect, strip
from veilwork.functions.vault import vault
from veilwork.operators.ranking import ranked

#: Values and pieces up to so many bytes are sent to all tasks.
BROADCAST_BYTES = 20 << 20


def detected(texts: DataFrame, how: Detect, text: str = "text", to: str = "spans") -> DataFrame:
    """texts with the spans of each; a text over the cap raises."""
    value = F.col(text)
    if how.max_chars:
        value = F.when(T.too_long(value, how.max_chars), F.raise_error(F.concat(F.lit(f"text is over {how.max_chars} characters: "), F.length(value)))).otherwise(value).cast("string")
    return texts.withColumn(to, detect(value, how.patterns()))


def within_cap(texts: DataFrame, how: Detect, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(texts within the cap, texts over it): for jobs that set long texts aside instead of failing on the first."""
    over = F.coalesce(T.too_long(F.col(text), how.max_chars), F.lit(False))
    return texts.filter(~over), texts.filter(over)


def entities(found: DataFrame, *keys: str, spans: str = "spans") -> DataFrame:
    """One row per span; where a key has the name of a span's field, the field is called span_<name>."""
    fields = ("start", "end", "category", "text", "confidence", "source")
    # explode() would put a filter on the array below itself, and the array would be computed for it once more.
    d = found.select(*[F.col(k).alias(f"key_{k}") for k in keys], F.explode_outer(spans).alias("d")).filter("d is not null")
    return d.select(*[F.col(f"key_{k}").alias(k) for k in keys], *[F.col(f"d.{f}").alias(f"span_{f}" if f in keys else f) for f in fields])


def analysis(found: DataFrame, *keys: str, values: bool = False) -> DataFrame:
    """entity_count and the list of entities; what was found is shown only if asked for."""
    shown = (lambda d: d["text"]) if values else (lambda d: F.lit("[redacted]"))
    entity = lambda d: F.struct(shown(d).alias("text"), d["category"].alias("category"), d["start"].alias("start"), d["end"].alias("end"), d["confidence"].alias("confidence"), d["source"].alias("source"))
    return found.select(*keys, F.size("spans").alias("entity_count"), F.transform("spans", entity).alias("entities"))


def redacted(found: DataFrame, text: str = "text", to: str = "masked") -> DataFrame:
    """Irreversible masking; tokens of a category are all alike."""
    return found.withColumn(to, T.redact(F.col(text), F.col("spans")))


def text_id(text: Column) -> Column:
    """What tells a text from all others; null for null."""
    return F.unhex(F.md5(text))


def met(found: DataFrame, session: str, order: str, text: str = "text") -> DataFrame:
    """(session, order, of, start, end, category, key, seen): the values met, stored once, so that texts are searched once. of names the text.

    These are few bytes against the texts; they go to the vault in force, which deletes them.
    """
    d = F.explode_outer("spans").alias("d")
    each = found.select(F.col(session).alias("a"), F.col(order).alias("b"), text_id(F.col(text)).alias("of"), d).filter("d is not null")
    return vault(found.sparkSession).keep(each.select(F.col("a").alias(session), F.col("b").alias(order), "of", "d.start", "d.end", "d.category", strip(F.col("d.text")).alias("key"), F.struct("d.confidence", "d.source").alias("seen")))


def few(rows: DataFrame, *texts: str) -> bool:
    """Whether stored rows with these texts are so few bytes that they may be sent about."""
    size = sum((F.coalesce(F.octet_length(t), F.lit(0)) for t in texts), F.lit(96))
    return (rows.agg(F.sum(size)).head()[0] or 0) <= BROADCAST_BYTES


def session_tokens(values: DataFrame, session: str, order: str, keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(session, key, category, token) of values met: a number for each distinct value of a session and category.

    Texts are met by `order`, the values of one text from its end to its start; the first place at which a value is met gives its
    category and its turn to be numbered. A value met again keeps its token, whatever category it is then found in. keep stores what
    must be stored on the way; a checkpoint by default.
    """
    each = values.select(session, order, "of", "category", "key", (-F.col("start")).alias("back"))
    place = [order, "of", "back"]
    first = each.groupBy(session, "key").agg(F.min(F.struct(*place, "category")).alias("at")).select(session, "key", *[f"at.{c}" for c in place], "at.category")
    token = F.concat(F.lit("["), F.col("category"), F.lit("_"), F.col("rank"), F.lit("]"))
    if few(values, "key", "category"):
        placed = first.withColumn("rank", F.row_number().over(Window.partitionBy(session, "category").orderBy(*place)) - 1)
    else:  # a session may then be too large for one task
        placed = ranked(first, [session, "category"], place, keep=keep or vault(values.sparkSession).keep)
    return placed.select(session, "key", "category", token.alias("token"))


def brought(texts: DataFrame, side: DataFrame, session: str, text: str, what: str, small: bool) -> DataFrame:
    """texts with `what` of side (session, of, what) as __what, by session and text."""
    there = side.select(F.col(session).alias("__session"), F.col("of").alias("__of"), F.col(what).alias("__what"))
    same = F.col(session).eqNullSafe(F.col("__session")) & (text_id(F.col(text)) == F.col("__of"))
    return texts.join(F.broadcast(there) if small else there, same, "left").drop("__session", "__of")


def alike(a: DataFrame, b: DataFrame, session: str, *names: str) -> DataFrame:
    """Inner join by names and by session, null sessions alike."""
    b = b.withColumnsRenamed({session: "__session", **{n: f"__{n}" for n in names}})
    same = reduce(lambda x, n: x & (F.col(n) == F.col(f"__{n}")), names, F.col(session).eqNullSafe(F.col("__session")))
    return a.join(b, same).drop("__session", *[f"__{n}" for n in names])


def tokenized(texts: DataFrame, values: DataFrame, tokens: DataFrame, session: str, text: str = "text", to: str = "masked") -> DataFrame:
    """Texts with each value met replaced by its session's token.

    Up to BROADCAST_BYTES of values are sent to the texts; beyond, texts and values are shuffled to meet.
    """
    places = values.select(session, "of", "start", "end", "key").distinct()
    pieces = alike(places, tokens.select(session, "key", "token"), session, "key").groupBy(session, "of").agg(F.sort_array(F.collect_list(F.struct("start", "end", "token"))).alias("pieces"))
    both = brought(texts, pieces, session, text, "pieces", few(values, "category"))
    none = F.expr("cast(array() as array<struct<start:int,end:int,token:string>>)")
    return both.withColumn(to, T.splice(T.escape(F.col(text)), F.coalesce("__what", none))).drop("__what")


def held_values(masked: DataFrame, tokens: DataFrame, session: str, text: str = "masked") -> DataFrame:
    """(session, of, values): for each masked text the tokens that it holds, in lower case, and their values; stored."""
    each = F.explode(F.array_distinct(F.transform(T.tokens_in(F.col(text)), F.lower))).alias("t")
    held = masked.select(session, text_id(F.col(text)).alias("of"), each).distinct()
    known = alike(held, tokens.select(session, F.lower("token").alias("t"), "key"), session, "t")
    return vault(masked.sparkSession).keep(known.groupBy(session, "of").agg(F.map_from_entries(F.collect_list(F.struct("t", "key"))).alias("values")))


def restored(masked: DataFrame, tokens: DataFrame, session: str, text: str = "masked", to: str = "restored") -> DataFrame:
    """Tokens become values again, in either case of letters; only the tokens that a text holds are brought to it."""
    values = held_values(masked, tokens, session, text)
    said = values.select(F.array_join(F.map_values("values"), "").alias("said"), (F.size("values") * 96).alias("n"))
    small = (said.agg(F.sum(F.octet_length("said") + F.col("n"))).head()[0] or 0) <= BROADCAST_BYTES
    both = brought(masked, values, session, text, "values", small)
    return both.withColumn(to, T.restore(F.col(text), F.coalesce("__what", F.expr("cast(map() as map<string,string>)")))).drop("__what")


def categories(found: DataFrame) -> DataFrame:
    """Number of spans by category."""
    return entities(found).groupBy("category").agg(F.count("*").alias("n"))


def entity_details(found: DataFrame, *keys: str, hash_key: str | None = None) -> DataFrame:
    """What a log may hold of each span: no value, but its place, its length and, with a key, its hash."""
    d = entities(found, *keys)
    out = d.select(*keys, "category", "start", "end", (F.col("end") - F.col("start")).alias("length"), "confidence", "source", "text")
    if hash_key:
        out = out.withColumn("entity_hash", T.entity_hash(hash_key, F.col("category"), F.col("text")))
    return out.drop("text")


def linked(found: DataFrame, key: str, hash_key: str) -> DataFrame:
    """Values that several documents share, by hash: documents and mentions of each."""
    d = entity_details(found, key, hash_key=hash_key)
    return d.groupBy("category", "entity_hash").agg(F.countDistinct(key).alias("documents"), F.count("*").alias("mentions")).filter("documents > 1")


def with_caller_spans(texts: DataFrame, spans: DataFrame, *keys: str, source: str = "caller") -> DataFrame:
    """texts with spans (keys, start, end, category) that the caller names, of confidence 1, by place. Null keys are alike; of texts with equal keys each gets the spans."""
    named = spans.groupBy(*keys).agg(F.sort_array(F.collect_set(F.struct("start", "end", "category"))).alias("__named")).withColumnsRenamed({k: f"__{k}" for k in keys})
    both = texts.join(named, reduce(lambda x, k: x & F.col(k).eqNullSafe(F.col(f"__{k}")), keys, F.lit(True)), "left")
    said = lambda d: F.substring(F.col("text"), d["start"] + 1, d["end"] - d["start"])
    made = F.transform("__named", lambda d: F.struct(d["start"].alias("start"), d["end"].alias("end"), d["category"].alias("category"), said(d).alias("text"), F.lit(1.0).alias("confidence"), F.lit(source).alias("source")).cast(SPAN))
    return both.withColumn("spans", F.coalesce(made, F.expr(f"cast(array() as array<{SPAN}>)"))).drop("__named", *[f"__{k}" for k in keys])


# Conversations

HINT = "The conversation contains placeholders such as [EMAIL_0]. Keep them as they are in your answer."


def skipped(model: Column, prefixes: tuple[str, ...]) -> Column:
    """Whether a model's texts are left alone: its name begins with one of the prefixes."""
    return reduce(lambda a, b: a | b, [F.startswith(model, F.lit(p)) for p in prefixes], F.lit(False))


def masked_conversations(rows: DataFrame, how: Detect, hint: str | None = HINT) -> tuple[DataFrame, DataFrame]:
    """(conv_id, turn, role, text) masked per conversation, and its tokens; a conversation with tokens gets a hint as its first row."""
    values = met(detected(rows, how), "conv_id", "turn")
    tokens = session_tokens(values, "conv_id", "turn")
    masked = tokenized(rows, values, tokens, "conv_id").select("conv_id", "turn", "role", F.col("masked").alias("text"))
    if hint:
        first = tokens.select("conv_id").distinct().select("conv_id", F.lit(-1).cast("long").alias("turn"), F.lit("system").alias("role"), F.lit(hint).alias("text"))
        masked = masked.unionByName(first)
    return masked, tokens


def restored_conversations(rows: DataFrame, tokens: DataFrame, text: str = "text") -> DataFrame:
    """rows (conv_id and a text, answers of a model for instance) with the tokens of their conversation restored."""
    return restored(rows, tokens, "conv_id", text, text)


def _with_texts(chats: DataFrame, key: str, change: Callable[[DataFrame], tuple[DataFrame, str, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """chats with each text of their messages changed; change takes (key, chat, place, text) and returns (rows, the new text's name, tokens)."""
    none = F.expr("cast(array() as array<string>)")
    chat = F.unhex(F.md5(F.to_json(F.struct(F.col(key).alias("k"), F.col("messages").alias("m")))))
    # Rows alike are changed alike, so each distinct chat is taken once.
    each = chats.select(key, chat.alias("chat"), "messages").dropDuplicates(["chat"]).select(key, "chat", F.posexplode("messages").alias("m", "msg"))
    legacy = "function_args" in chats.schema["messages"].dataType.elementType.names
    content, args = F.coalesce("msg.content", none), F.coalesce("msg.tool_args", none)
    call = F.col("msg.function_args") if legacy else F.lit(None).cast("string")
    each = each.select(key, "chat", "m", "msg.role", F.size(content).alias("n"), F.size(args).alias("k"), F.concat(content, args, F.array(call)).alias("parts"))
    place = F.concat(F.hex("chat"), F.lpad(F.col("m").cast("string"), 9, "0"), F.lpad(F.col("p").cast("string"), 9, "0"))
    texts = each.select(key, "chat", "m", F.posexplode("parts").alias("p", "text")).select(key, "chat", "m", "p", place.alias("place"), "text")
    done, changed, tokens = change(texts)
    parts = done.groupBy("chat", "m").agg(F.transform(F.sort_array(F.collect_list(F.struct("p", F.col(changed).alias("t")))), lambda x: x["t"]).alias("t"))
    back = each.drop("parts").join(parts, ["chat", "m"])
    fields = [F.col("role"), F.slice("t", F.lit(1), F.col("n")).alias("content"), F.slice("t", F.col("n") + 1, F.col("k")).alias("tool_args"), *([F.get("t", F.col("n") + F.col("k")).alias("function_args")] if legacy else [])]
    whole = back.groupBy("chat").agg(F.transform(F.sort_array(F.collect_list(F.struct("m", F.struct(*fields).alias("msg")))), lambda x: x["msg"]).alias("__messages")).withColumnRenamed("chat", "__chat")
    out = chats.join(whole, chat == F.col("__chat"), "left")
    return out.withColumn("messages", F.coalesce("__messages", "messages")).drop("__messages", "__chat"), tokens


def masked_messages(chats: DataFrame, how: Detect, key: str = "conv_id", hint: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Chats (key, messages array<struct<role, content array<string>, tool_args array<string>>>), a row each, and their tokens.

    Parts of contents, arguments of tool calls and those of a legacy call (function_args, a string; the struct may lack it) are texts
    like any other; within a chat they share tokens, in the order in which they stand. Everything comes back in its place. With a
    hint, a chat with tokens has it as a part of its first message if that is the system's, else as a message before all others.
    """

    def change(texts: DataFrame) -> tuple[DataFrame, str, DataFrame]:
        values = met(detected(texts, how), key, "place")
        tokens = session_tokens(values, key, "place")
        return tokenized(texts, values, tokens, key), "masked", tokens

    rows, tokens = _with_texts(chats, key, change)
    if hint:
        named = tokens.select(F.col(key).alias("__key"), F.lit(True).alias("__named")).distinct()
        kind = rows.schema["messages"].dataType.elementType
        first = F.get("messages", F.lit(0))
        own = F.struct(*[{"role": F.lit("system"), "content": F.array(F.lit(hint))}.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name) for f in kind.fields])
        more = F.struct(*[(F.concat(first["content"], F.array(F.lit(hint))) if f.name == "content" else first[f.name]).alias(f.name) for f in kind.fields])
        told = F.when(first["role"] == "system", F.concat(F.array(more), F.slice("messages", F.lit(2), F.greatest(F.size("messages") - 1, F.lit(0))))).otherwise(F.concat(F.array(own), F.col("messages")))
        rows = rows.join(named, F.col(key).eqNullSafe(F.col("__key")), "left").withColumn("messages", F.when(F.col("__named"), told).otherwise(F.col("messages"))).drop("__key", "__named")
    return rows, tokens


def restored_messages(chats: DataFrame, tokens: DataFrame, key: str = "conv_id") -> DataFrame:
    """Chats of the same form (a model's answers) with the tokens of their chat restored in contents and in arguments of calls."""
    return _with_texts(chats, key, lambda texts: (restored(texts, tokens, key, "text"), "restored", tokens))[0]

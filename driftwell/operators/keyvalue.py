"""Rows and typed objects as commands of a key-value store, command routing, and statistics of keys."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.slots import slot
from ..functions.values import canonical, text_or_hex
from ..meta import TableMeta


def row_commands(changes: DataFrame, meta: TableMeta) -> DataFrame:
    """``key`` and ``args`` of the command for each change: ``hset key column value ...`` or ``del key``.

    The key is ``schema.table.value`` of the first ordering column; null values are empty text; rows without a key are dropped, and
    so are all rows of a keyless table.
    """
    if meta.is_bag:
        return changes.select(F.lit(None).cast("string").alias("key"), F.lit(None).cast("array<string>").alias("args")).limit(0)
    columns = changes.schema["after"].dataType
    image = F.when(F.col("op") == "delete", F.col("before")).otherwise(F.col("after"))
    key = F.concat(F.lit(f"{meta.schema}.{meta.table}."), image[meta.order_cols[0]].cast("string"))
    text = lambda f: F.coalesce(text_or_hex(F.col("after")[f.name]) if f.dataType.typeName() == "binary" else canonical(F.col("after")[f.name], f.dataType), F.lit(""))
    pairs = [x for f in columns for x in (F.lit(f.name), text(f))]
    put, gone = F.array(F.lit("hset"), key, *pairs), F.array(F.lit("del"), key)
    return changes.select(key.alias("key"), F.when(F.col("op") == "delete", gone).otherwise(put).alias("args")).filter("key IS NOT NULL")


def object_commands(objects: DataFrame) -> DataFrame:
    """Commands that rebuild objects: (``db``, ``key``, ``part``, ``args``) from (db, key, type, items, expire_ms).

    ``items``: an array of structs (name, value, expires).  Types string, list, set, hash, zset; a module can't be rebuilt and fails.
    ``expire_ms`` counts from now.
    """
    item = lambda e, *parts: F.array(*parts)
    one = (
        F.when(F.col("type") == "list", F.transform("items", lambda e: item(e, F.lit("rpush"), F.col("key"), e["value"])))
        .when(F.col("type") == "set", F.transform("items", lambda e: item(e, F.lit("sadd"), F.col("key"), e["value"])))
        .when(F.col("type") == "hash", F.flatten(F.transform("items", lambda e: F.when(
            e["expires"].isNull(), F.array(item(e, F.lit("hset"), F.col("key"), e["name"], e["value"]))
        ).otherwise(F.array(
            item(e, F.lit("hset"), F.col("key"), e["name"], e["value"]),
            item(e, F.lit("hpexpireat"), F.col("key"), e["expires"].cast("string"), F.lit("fields"), F.lit("1"), e["name"]),
        )))))
        .when(F.col("type") == "zset", F.transform("items", lambda e: item(e, F.lit("zadd"), F.col("key"), e["value"], e["name"])))
        .when(F.col("type") == "string", F.transform("items", lambda e: item(e, F.lit("set"), F.col("key"), e["value"])))
        .otherwise(F.raise_error(F.concat(F.lit("objects of this type cannot be rewritten: "), F.col("type"))).cast("array<array<string>>"))
    )
    expire = F.when(F.col("expire_ms") > 0, F.array(F.array(F.lit("pexpire"), F.col("key"), F.col("expire_ms").cast("string")))).otherwise(F.array().cast("array<array<string>>"))
    return objects.select("db", "key", F.posexplode(F.concat(one, expire)).alias("part", "args"))


#: Commands whose only key is their first argument, by the kind of object.
ONE_KEY = """
APPEND DECR DECRBY GET GETDEL GETEX GETRANGE GETSET INCR INCRBY INCRBYFLOAT PSETEX SET SETEX SETNX SETRANGE STRLEN SUBSTR
HDEL HEXISTS HGET HGETALL HINCRBY HINCRBYFLOAT HKEYS HLEN HMGET HMSET HRANDFIELD HSCAN HSET HSETNX HSTRLEN HVALS
LINDEX LINSERT LLEN LPOP LPOS LPUSH LPUSHX LRANGE LREM LSET LTRIM RPOP RPUSH RPUSHX
SADD SCARD SISMEMBER SMEMBERS SMISMEMBER SPOP SRANDMEMBER SREM SSCAN
ZADD ZCARD ZCOUNT ZINCRBY ZLEXCOUNT ZMSCORE ZPOPMAX ZPOPMIN ZRANDMEMBER ZRANGE ZRANGEBYLEX ZRANGEBYSCORE ZRANK ZREM ZREMRANGEBYLEX
ZREMRANGEBYRANK ZREMRANGEBYSCORE ZREVRANGE ZREVRANGEBYLEX ZREVRANGEBYSCORE ZREVRANK ZSCAN ZSCORE
XACK XADD XAUTOCLAIM XCLAIM XDEL XLEN XPENDING XRANGE XREVRANGE XSETID XTRIM
BITCOUNT BITFIELD BITFIELD_RO BITPOS GETBIT SETBIT GEOADD GEODIST GEOHASH GEOPOS GEOSEARCH GEORADIUS_RO GEORADIUSBYMEMBER_RO PFADD
DUMP EXPIRE EXPIREAT EXPIRETIME MOVE PERSIST PEXPIRE PEXPIREAT PEXPIRETIME PTTL RESTORE RESTORE-ASKING SORT_RO TTL TYPE
""".split()
#: Where several keys stand: first, last (negative: from the end), step.
KEY_PLACES: dict[str, tuple[int, int, int]] = {
    **dict.fromkeys(ONE_KEY, (1, 1, 1)),
    **dict.fromkeys("DEL EXISTS MGET PFCOUNT PFMERGE SDIFF SDIFFSTORE SINTER SINTERSTORE SUNION SUNIONSTORE TOUCH UNLINK WATCH".split(), (1, -1, 1)),
    **dict.fromkeys("BLPOP BRPOP BZPOPMAX BZPOPMIN".split(), (1, -2, 1)),
    **dict.fromkeys("MSET MSETNX".split(), (1, -1, 2)),
    **dict.fromkeys("BLMOVE BRPOPLPUSH COPY GEOSEARCHSTORE LCS LMOVE RENAME RENAMENX RPOPLPUSH SMOVE ZRANGESTORE".split(), (1, 2, 1)),
    "BITOP": (2, -1, 1),
    **dict.fromkeys("MEMORY OBJECT PFDEBUG XGROUP XINFO".split(), (2, 2, 1)),
}
#: Where the number of the keys that follow it stands; a name that ends in STORE has a key before it.
KEY_NUMBERS: dict[str, int] = {
    **dict.fromkeys("LMPOP SINTERCARD ZDIFF ZINTER ZINTERCARD ZMPOP ZUNION".split(), 1),
    **dict.fromkeys("BLMPOP BZMPOP EVAL EVALSHA EVALSHA_RO EVAL_RO FCALL FCALL_RO ZDIFFSTORE ZINTERSTORE ZUNIONSTORE".split(), 2),
}
#: A first key, and others each behind one of these words.
KEY_WORDS: dict[str, tuple[str, ...]] = {"SORT": ("STORE",), "GEORADIUS": ("STORE", "STOREDIST"), "GEORADIUSBYMEMBER": ("STORE", "STOREDIST")}
#: Keys from behind the word STREAMS on, as many as other values after them.
STREAM_READS = ("XREAD", "XREADGROUP")
KEYLESS = "AUTH DISCARD EXEC FLUSHALL FLUSHDB FUNCTION MULTI PING PUBLISH REPLCONF SCRIPT SELECT SWAPDB UNWATCH WAIT".split()


def command_keys(args: Column) -> Column:
    """The keys of a command; an empty array for one without keys; unknown commands fail."""
    name = F.upper(args[0])
    none = F.array().cast("array<string>")
    out = F.when(name.isin(*KEYLESS), none)
    places: dict[tuple[int, int, int], list[str]] = {}
    for command, where in KEY_PLACES.items():
        places.setdefault(where, []).append(command)
    for (first, last, step), names in places.items():
        end = F.size(args) + last if last < 0 else F.lit(last)
        picked = F.transform(F.sequence(F.lit(first), F.greatest(end, F.lit(first)), F.lit(step)), lambda i: F.get(args, i))
        out = out.when(name.isin(*names), picked)
    for place in sorted(set(KEY_NUMBERS.values())):
        some = [c for c, at in KEY_NUMBERS.items() if at == place]
        stored = F.when(name.endswith("STORE"), F.array(F.get(args, F.lit(1)))).otherwise(none)
        out = out.when(name.isin(*some), F.concat(stored, F.slice(args, F.lit(place + 2), F.get(args, F.lit(place)).cast("int"))))
    words = F.transform(args, lambda a: F.upper(a))
    for command, marks in KEY_WORDS.items():
        behind = [F.when(F.array_position(words, w) > 2, F.get(args, F.array_position(words, w).cast("int"))) for w in marks]
        out = out.when(name == command, F.array_compact(F.array(F.get(args, F.lit(1)), *behind)))
    start = F.array_position(words, "STREAMS").cast("int")
    reads = F.slice(args, start + 1, F.greatest(((F.size(args) - start) / 2).cast("int"), F.lit(0)))
    out = out.when(name.isin(*STREAM_READS), F.when(start > 0, reads).otherwise(none))
    return out.otherwise(F.raise_error(F.concat(F.lit("unknown command: "), name)).cast("array<string>"))


def route_commands(commands: DataFrame, nodes: Sequence[tuple[int, int]], args: str = "args") -> DataFrame:
    """``node`` of each command by its keys' slot; keys of different nodes fail, a command without keys goes to every node.

    ``nodes``: first and last slot of each.
    """
    place = slot  # one slot per key
    slots = F.transform(command_keys(F.col(args)), lambda k: place(k))
    node = F.lit(None).cast("int")
    of = lambda s: F.coalesce(*[F.when((s >= a) & (s <= b), F.lit(n)) for n, (a, b) in enumerate(nodes)], node)
    found = F.array_distinct(F.transform(slots, of))
    checked = F.when(F.size(found) <= 1, found).otherwise(F.raise_error(F.lit("keys of one command belong to several nodes")).cast("array<int>"))
    everywhere = F.array(*[F.lit(n) for n in range(len(nodes))])
    return commands.withColumn("node", F.explode(F.when(F.size(checked) == 0, everywhere).otherwise(checked)))


def large_or_hot(stats: DataFrame, size: int = 0, frequency: int = 0) -> DataFrame:
    """Keys at or above either threshold; a threshold of 0 is none."""
    cond = F.lit(False)
    if size:
        cond = cond | (F.col("size") >= size)
    if frequency:
        cond = cond | (F.col("freq") >= frequency)
    return stats.filter(cond if size or frequency else F.lit(True))


def keep_commands(commands: DataFrame, ignored: Sequence[str], args: str = "args") -> DataFrame:
    return commands.filter(~F.upper(F.col(args)[0]).isin([x.upper() for x in ignored])) if ignored else commands


def with_db(commands: DataFrame, mapping: Mapping[int, int]) -> DataFrame:
    from .routing import route_db

    return commands.withColumn("db", route_db(F.col("db"), mapping))

"""Sessions, messages, accounts: owner-scoped reads, latest-wins writes, deletes as anti joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestack.config import RetrievalConfig
from lodestack.functions.text import date_bucket

CONFIG = RetrievalConfig()
GROUPS = ("Today", "Yesterday", "Previous 7 days", "Earlier")


def owned(sessions: DataFrame, user_id) -> DataFrame:
    return sessions.where(F.col("user_id") == user_id)


def owner_messages(messages: DataFrame, sessions: DataFrame, user_id=None) -> DataFrame:
    """Messages of sessions that have an owner, or that one user owns."""
    mine = sessions if user_id is None else owned(sessions, user_id)
    return messages.join(mine.select("session_id", "user_id"), "session_id")


def recent(messages: DataFrame, n: int | None = CONFIG.history_messages) -> DataFrame:
    """The last n messages of each session with place, chronological from 0; all without n."""
    last = Window.partitionBy("session_id").orderBy(F.col("sequence").desc())
    rows = messages if n is None else messages.withColumn("__n", F.row_number().over(last)).where(F.col("__n") <= n).drop("__n")
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("session_id").orderBy("sequence")) - 1)


def history_text(messages: DataFrame, config: RetrievalConfig = CONFIG) -> DataFrame:
    """session_id, history: ``role: content`` lines of recent messages, each and the whole within bounds, from the end."""
    lines = recent(messages, config.history_messages).withColumn("line", F.concat(F.col("role"), F.lit(": "), F.substring("content", 1, config.message_chars)))
    text = lines.groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sequence", "line"))), lambda x: x["line"]), "\n").alias("h"))
    return text.select("session_id", F.expr(f"right(h, {config.history_chars})").alias("history"))


def list_sessions(sessions: DataFrame, user_id=None) -> DataFrame:
    """Newest first, ties by id."""
    return (sessions if user_id is None else owned(sessions, user_id)).orderBy(F.col("updated_at").desc(), "session_id")


def session_count(sessions: DataFrame, user_id=None) -> DataFrame:
    """sessions: how many there are, of one user or of all."""
    return (sessions if user_id is None else owned(sessions, user_id)).agg(F.count("*").alias("sessions"))


def get_session(sessions: DataFrame, session_id, user_id) -> DataFrame:
    """The session if the user owns it; no row otherwise."""
    return owned(sessions, user_id).where(F.col("session_id") == session_id)


def search_sessions(sessions: DataFrame, text: str) -> DataFrame:
    """Sessions whose name holds the trimmed text in any case, taken literally."""
    return sessions.where(F.contains(F.lower("doc_name"), F.lower(F.trim(F.lit(text)))))


def grouped_sessions(sessions: DataFrame, now: Column) -> DataFrame:
    """``sessions`` with bucket and bucket_order; groups without sessions don't appear."""
    bucket = date_bucket(F.col("updated_at"), now)
    place = F.coalesce(*[F.when(bucket == g, i) for i, g in enumerate(GROUPS)])
    return sessions.withColumn("bucket", bucket).withColumn("bucket_order", place)


def upsert_sessions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Later rows win; the owner and the creation of a session that is there stay."""
    rows = old.withColumn("__new", F.lit(0)).unionByName(new.select(*old.columns).withColumn("__new", F.lit(1)))
    latest = Window.partitionBy("session_id").orderBy(F.col("__new").desc(), F.col("updated_at").desc())
    first = Window.partitionBy("session_id").orderBy("__new", "updated_at").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    kept = rows.select("*", *[F.first(c).over(first).alias(f"__{c}") for c in ("user_id", "created_at")], F.row_number().over(latest).alias("__n")).where("__n = 1")
    return kept.select(*[F.col(f"__{c}").alias(c) if c in ("user_id", "created_at") else F.col(c) for c in old.columns])


def delete_sessions(ids: DataFrame, sessions: DataFrame, *children: DataFrame) -> tuple[DataFrame, ...]:
    """``sessions`` and their child tables without the given session ids."""
    return tuple(t.join(ids.select("session_id"), "session_id", "left_anti") for t in (sessions, *children))


def save_turn(messages: DataFrame, sessions: DataFrame, turn: DataFrame) -> DataFrame:
    """``messages`` with the rows of ``turn`` whose session their user_id owns; other rows raise an error before any write."""
    fitting = turn.join(sessions.select("session_id", "user_id"), ["session_id", "user_id"], "left_anti")
    if not fitting.isEmpty():
        raise LookupError("a turn's session isn't there or has another owner")
    return messages.unionByName(turn.select(*messages.columns))


def insert_users(users: DataFrame, new: DataFrame) -> DataFrame:
    """``users`` and new ones whose e-mail is free."""
    return users.unionByName(new.dropDuplicates(["email"]).join(users.select("email"), "email", "left_anti").select(*users.columns))


def current_users(users: DataFrame, auth_sessions: DataFrame, token_hashes: DataFrame, now: Column) -> DataFrame:
    """token_hash, id, name, email of tokens that are known and haven't expired."""
    live = auth_sessions.where(F.col("expires_at") > now).join(token_hashes, "token_hash", "left_semi")
    return live.join(users, live["user_id"] == users["id"]).select("token_hash", "id", "name", "email")


def revoke_token(auth_sessions: DataFrame, token: str) -> DataFrame:
    """``auth_sessions`` without the one of a token, which is stored as its SHA-256."""
    return auth_sessions.where(~F.col("token_hash").eqNullSafe(F.sha2(F.lit(token), 256)))


def rotate_tokens(auth_sessions: DataFrame, revoked: DataFrame, issued: DataFrame, now: Column) -> DataFrame:
    """Without expired and revoked tokens, with the issued ones."""
    return auth_sessions.where(F.col("expires_at") > now).join(revoked.select("token_hash"), "token_hash", "left_anti").unionByName(issued)

"""Rows that users and services add: projects, documents, messages; and what clients show of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .relational import lookup, where_all
from .retrieval import marks

# What is shown where something is absent, and seconds that answers may be cached.
NO_ANSWER = "Tôi không tìm thấy đủ thông tin trong tài liệu để trả lời câu hỏi này."
UNTITLED, UNCATEGORIZED = "Untitled Project", "Uncategorized"
CACHE = {"documents": (10, 300), "summaries": (5, 86_400), "list": (120, 120), "detail": (300, 300)}


def new_rows(rows: DataFrame, **values: Column) -> DataFrame:
    """rows with a random id, the time of creation and the given columns. Write them once: a second evaluation has other ids."""
    return rows.withColumns({"id": F.uuid(), "created_at": F.current_timestamp(), **values})


def new_projects(users: DataFrame) -> DataFrame:
    """A draft per row of users (user_id), with defaults and a collection name of its own."""
    name = F.concat(F.col("user_id"), F.lit("_"), F.replace(F.uuid(), F.lit("-"), F.lit("")))
    return new_rows(users, name=F.lit(UNTITLED), collection_name=name, is_draft=F.lit(True)).withColumn("updated_at", F.col("created_at"))


def finalize(projects: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(projects after, new documents, requests with status) for requests (id, user_id, name, domain, documents), one for each project at most.

    Only the owner's draft can be finalized; other requests are 404 and change nothing. The documents of a request that counts are added with status uploaded.
    """
    drafts = projects.where("is_draft").select("id", "user_id", F.lit(True).alias("__is"))
    judged = requests.join(drafts, ["id", "user_id"], "left").withColumn("status", F.when(F.col("__is"), 200).otherwise(404)).drop("__is")
    done = judged.where("status = 200")
    new = done.select("id", F.col("name").alias("__name"), F.col("domain").alias("__domain"), F.lit(True).alias("__done"))
    after = projects.join(new, "id", "left")
    changed = {"name": F.col("__name"), "domain": F.col("__domain"), "is_draft": F.lit(False), "updated_at": F.current_timestamp()}
    after = after.withColumns({c: F.when(F.col("__done"), v).otherwise(F.col(c)) for c, v in changed.items()}).drop("__name", "__domain", "__done")
    documents = done.select(F.col("id").alias("project_id"), "user_id", F.explode("documents").alias("__d")).select("project_id", "user_id", "__d.*")
    return after, new_rows(documents, status=F.lit("uploaded")), judged


def add_documents_status(projects: DataFrame, existing: DataFrame, requests: DataFrame, most: int = 10) -> DataFrame:
    """Requests (project_id, user_id, n) with status: 404 unless the project is the user's own and no draft, 400 beyond the quota, else 200."""
    ready = projects.where("not is_draft").select(F.col("id").alias("project_id"), "user_id", F.lit(True).alias("__is"))
    have = existing.groupBy("project_id").agg(F.count("*").alias("__have"))
    out = requests.join(ready, ["project_id", "user_id"], "left").join(have, "project_id", "left")
    status = F.when(F.col("__is").isNull(), 404).when(F.coalesce("__have", F.lit(0)) + F.col("n") > most, 400).otherwise(200)
    return out.withColumn("status", status).drop("__is", "__have")


def chat_messages(turns: DataFrame) -> DataFrame:
    """The user's and the assistant's row of every turn (thread_id, user_id, project_id, question, answer, citations, chunks_retrieved, fact_check).

    The user's has neither citations nor a check; the order of the two is that of `place`.
    """
    same = ["thread_id", "user_id", "project_id"]
    kinds = {c: turns.schema[c].dataType for c in ("citations", "chunks_retrieved", "fact_check")}
    asked = turns.select(*same, F.lit(0).alias("place"), F.lit("user").alias("role"), F.col("question").alias("content"), *[F.lit(None).cast(k).alias(c) for c, k in kinds.items()])
    told = turns.select(*same, F.lit(1).alias("place"), F.lit("assistant").alias("role"), F.col("answer").alias("content"), *kinds)
    return new_rows(asked.unionByName(told))


def history_rows(messages: DataFrame) -> DataFrame:
    """(message): the ten fields of a message that clients see, as a struct."""
    return messages.select(F.struct("id", "user_id", "project_id", "thread_id", "role", "content", "citations", "chunks_retrieved", "fact_check", "created_at").alias("message"))


def answer_or_none(answer: Column, sources: Column) -> Column:
    """struct(answer, citations); where no source has survived, the fixed answer without citations."""
    none = F.coalesce(F.size(sources), F.lit(0)) <= 0
    return F.struct(F.when(none, F.lit(NO_ANSWER)).otherwise(answer).alias("answer"), F.when(none, F.filter(F.coalesce(sources, F.array()), lambda _: F.lit(False))).otherwise(sources).alias("citations"))


def marked_citations(messages: DataFrame, key: list[str]) -> DataFrame:
    """(key, place, *citation): the citation of every mark of an answer, in order; marks that name none are left out."""
    named = messages.select(*key, F.posexplode(marks(F.col("answer"))).alias("place", "__n"))
    cited = messages.select(*key, F.inline("citations"))
    return named.withColumn("source_marker", F.concat(F.lit("S"), "__n")).drop("__n").join(cited, [*key, "source_marker"])


def add_files(chosen: Column, picked: Column, most: int) -> Column:
    """The files that stay when some are added: the first ones, as many as are allowed."""
    return F.slice(F.concat(chosen, picked), 1, most)


def two_level_lookup(column: Column, major: dict[str, str], values: dict[str, str], default: str) -> Column:
    """The value of what a name belongs to, or of the name itself where it belongs to nothing."""
    pairs = [F.lit(x) for kv in major.items() for x in kv]
    return lookup(F.coalesce(F.try_element_at(F.create_map(*pairs), column), column), values, default)


def card(*, name: Column, domain: Column, is_draft: Column, file_name: Column, description: Column) -> Column:
    """struct(title, domain, document, about): what cards show where something is absent. Blank names of projects count as absent, empty domains too."""
    filled = F.coalesce(F.nullif(F.trim(name), F.lit("")), F.lit(UNTITLED))
    return F.struct(
        F.when(is_draft, F.lit("Draft")).otherwise(filled).alias("title"), F.coalesce(F.nullif(domain, F.lit("")), F.lit(UNCATEGORIZED)).alias("domain"),
        F.coalesce(name, file_name, F.lit("Untitled")).alias("document"), F.coalesce(description, domain, F.lit("General research")).alias("about"),
    )


def upload_path(user: Column, project: Column, time: Column, random: Column, name: Column) -> Column:
    """Where an uploaded file is put."""
    safe = F.regexp_replace(name, r"[^a-zA-Z0-9._-]", "_")
    return F.concat_ws("/", user, project, F.concat_ws("_", time, random, safe))


def one_or_404(df: DataFrame, **equal) -> DataFrame:
    """The one row that has all values; LookupError if there is none, ValueError if there are several. Two rows are fetched at most."""
    found = where_all(df, **equal)
    n = len(found.limit(2).collect())
    if n != 1:
        raise LookupError("404") if not n else ValueError("several rows")
    return found


def cache_seconds(kind: str, *, pending: Column, empty: Column) -> Column:
    """How long an answer of a kind may be cached: documents shorter while something is pending, summaries while there are none."""
    short, long = CACHE[kind]
    return F.when(pending if kind == "documents" else empty if kind == "summaries" else F.lit(False), short).otherwise(long)


def cache_seconds_by(kind: Column, short: Column) -> Column:
    """How long an answer may be cached where the kind is a column; short says that something is pending, or that it is empty. Null for other kinds."""
    out = F.lit(None).cast("int")
    for name in CACHE:
        out = F.when(kind == name, cache_seconds(name, pending=short, empty=short)).otherwise(out)
    return out

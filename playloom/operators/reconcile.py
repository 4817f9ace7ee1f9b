"""What a promotion takes back: generations that came again as a rotated copy, and all that hangs on deleted sessions.

Evidence is kept as long as any session refers to it; references are counted over what is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def superseded(session_sources: DataFrame, revisions: DataFrame, incoming: DataFrame) -> DataFrame:
    """(session_id, revision_id) of links to a generation that a replacement followed, where the session comes again from another revision.

    ``revisions``: revision_id, path_id, generation, change_kind. ``incoming``: session_id, revision_id of the sessions that are promoted
    now. A rotated log gives the sessions of the log before the rotation once more, under the same session_id.
    """
    last = revisions.filter("change_kind = 'replaced'").groupBy("path_id").agg(F.max("generation").alias("replaced_at"))
    old = revisions.join(last, "path_id").filter("generation < replaced_at").select("revision_id")
    own = incoming.groupBy("session_id").agg(F.min("revision_id").alias("low"), F.max("revision_id").alias("high"))
    links = session_sources.select("session_id", "revision_id").join(old, "revision_id", "left_semi").join(own, "session_id")
    return links.filter("revision_id <> low or revision_id <> high").select("session_id", "revision_id").distinct()


def _unreferenced(evidence: DataFrame, links: DataFrame, touched: DataFrame) -> DataFrame:
    """Evidence of touched revisions that no link names."""
    return evidence.join(touched.select("revision_id").distinct(), "revision_id", "left_semi").join(links.select("evidence_id"), "evidence_id", "left_anti")


def reconcile(session_sources: DataFrame, session_evidence: DataFrame, evidence: DataFrame, revisions: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables of links and evidence (session_id, revision_id), (session_id, evidence_id), (evidence_id, revision_id), without what
    rotated copies supersede."""
    gone = superseded(session_sources, revisions, incoming)
    named = session_evidence.join(evidence.select("evidence_id", "revision_id"), "evidence_id").join(gone, ["session_id", "revision_id"], "left_semi")
    links = session_evidence.join(named.select("session_id", "evidence_id").distinct(), ["session_id", "evidence_id"], "left_anti")
    dropped = _unreferenced(evidence, links, gone)
    return session_sources.join(gone, ["session_id", "revision_id"], "left_anti"), links, evidence.join(dropped.select("evidence_id"), "evidence_id", "left_anti")


def cascade(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """All tables after sessions were deleted (``gone``: session_id).

    Rows of ``sessions``, ``session_sources``, ``session_evidence`` and ``segments`` go with their session. Evidence of the revisions the
    sessions were linked to goes once no session refers to it, servers once no segment does that did before.
    """
    out = {name: tables[name].join(gone, "session_id", "left_anti") for name in ("sessions", "session_sources", "session_evidence", "segments")}
    touched = tables["session_sources"].join(gone, "session_id", "left_semi")
    dropped = _unreferenced(tables["evidence"], out["session_evidence"], touched)
    out["evidence"] = tables["evidence"].join(dropped.select("evidence_id"), "evidence_id", "left_anti")
    left = tables["segments"].filter("server_id is not null").join(gone, "session_id", "left_semi").select("server_id").distinct()
    left = left.join(out["segments"].select("server_id"), "server_id", "left_anti")
    out["servers"] = tables["servers"].join(left, "server_id", "left_anti")
    return out


#: Keys of both tables that a task joins, so that its memory does not grow with the tables.
KEYS_A_TASK = 2_000_000


def orphans(sessions: DataFrame, segments: DataFrame) -> DataFrame:
    """(kind, session_id) of the sessions without a segment, and once each of the segments' keys without a session.

    Keys alone are shuffled, into as many parts as their number asks for (fixed ones, that adaptive execution does not join
    again); a part's keys of segments are made distinct before they are sorted.
    """
    spark = sessions.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(sessions.count() + segments.count()) // KEYS_A_TASK))
    own = sessions.select("session_id").repartition(parts, "session_id")
    named = segments.select("session_id").repartition(parts, "session_id").distinct()
    bare, lost = own.join(named, "session_id", "left_anti"), named.join(own, "session_id", "left_anti")
    return bare.select(F.lit("session").alias("kind"), "session_id").unionByName(lost.select(F.lit("segment").alias("kind"), "session_id"))

"""Several tables published as one: written apart, made visible together by one manifest.

The tables of a release are written below a fresh folder that no reader looks into. Then a manifest that names
the folder is created, and creating it fails if there is one: of several writers of a release one wins, and
what the others wrote is never seen. A writer that dies before the manifest leaves nothing visible either.
Readers go by manifests only; one that isn't written to its end doesn't count.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def _file_system(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark._jsc.hadoopConfiguration())


def delete_folder(spark: SparkSession, path: str) -> None:
    hadoop, files = _file_system(spark, path)
    files.delete(hadoop, True)


def _manifests(root: str) -> str:
    return f"{root.rstrip('/')}/_manifests"


class ContractError(ValueError):
    """A table doesn't keep its contract."""


def publish_checked(
    spark: SparkSession, name: str, table: DataFrame, root: str, release: str, enforced: Mapping[str, Column], counted: Mapping[str, Column] | None = None
) -> dict[str, int]:
    """Publish a table unless a row meets one of the ``enforced`` conditions; returns the counts of all conditions.

    Conditions are counted by the job that writes the table, so its rows are made once. After a failure the
    table is gone and the release name is free.
    """
    seen = Observation()
    conditions = {**enforced, **(counted or {})}
    watched = table.observe(seen, *[F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in conditions.items()])

    def check() -> None:
        broken = {n: seen.get[n] for n in enforced if seen.get[n]}
        if broken:
            raise ContractError(f"table {name} breaks its contract: {broken}")

    publish_together(spark, {name: watched}, root, release, check)
    return {n: int(seen.get[n]) for n in conditions}


def publish_together(spark: SparkSession, tables: Mapping[str, DataFrame], root: str, release: str, check: Callable[[], None] | None = None) -> str:
    """Write all tables, then publish them under a release name that nobody has used; returns their folder.

    ``check`` runs between the two and keeps the release unpublished by raising; tables that break a contract are deleted.
    """
    folder = f"{root.rstrip('/')}/{uuid.uuid4().hex}"
    if is_published(spark, root, release):  # spares the writing; the manifest decides
        raise FileExistsError(f"release {release} is published")
    for name, table in tables.items():
        table.write.mode("errorifexists").option("compression", "zstd").parquet(f"{folder}/{name}")
    if check:
        try:
            check()
        except ContractError:
            delete_folder(spark, folder)  # nobody will read it
            raise
    path, files = _file_system(spark, f"{_manifests(root)}/{release}.json")
    files.mkdirs(path.getParent())
    try:
        out = files.create(path, False)  # exclusive
    except Exception as error:
        raise FileExistsError(f"release {release} is published") from error
    try:
        out.write(bytearray(json.dumps({"release": release, "folder": folder, "tables": sorted(tables)}), "utf-8"))
    finally:
        out.close()
    return folder


def releases(spark: SparkSession, root: str, start: str = "") -> dict[str, dict]:
    """Published manifests by release name, of names that begin with ``start``; files are listed, not rows."""
    folder, files = _file_system(spark, _manifests(root))
    if not files.exists(folder):
        return {}
    out = {}
    for status in files.listStatus(folder):
        name = status.getPath().getName()
        if not name.endswith(".json") or not name.startswith(start):
            continue
        reader = files.open(status.getPath())
        try:
            text = bytes(reader.readAllBytes()).decode("utf-8")
        finally:
            reader.close()
        if text.endswith("}"):
            out[name.removesuffix(".json")] = json.loads(text)
    return dict(sorted(out.items()))


def is_published(spark: SparkSession, root: str, release: str) -> bool:
    return release in releases(spark, root, release)


def read_published(spark: SparkSession, root: str, table: str, release: str | None = None, start: str = "") -> DataFrame:
    """A table of one release, or of all whose names begin with ``start``; ``FileNotFoundError`` if there is none."""
    found = releases(spark, root, release or start)
    folders = [m["folder"] for name, m in found.items() if table in m["tables"] and (release is None or name == release)]
    if not folders:
        raise FileNotFoundError(f"table {table} is not published in {release or start or root}")
    return spark.read.parquet(*[f"{f}/{table}" for f in folders])

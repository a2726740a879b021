"""Folders that tasks read and write files of other formats in, by the addresses that Spark knows."""

from __future__ import annotations

import pyarrow as pa


def arrow_uri(uri: str) -> str:
    """A folder's address as pyarrow spells it: Hadoop's names of object stores are mapped to its own.

    s3a and s3n are s3; wasb and wasbs, the older names of Azure's containers, are abfs and abfss on the same account. hdfs, viewfs,
    gs, abfs, abfss, file and plain paths stay as they are.
    """
    scheme, sep, rest = uri.partition("://")
    if not sep:
        return uri
    if scheme in ("s3a", "s3n"):
        return f"s3://{rest}"
    if scheme in ("wasb", "wasbs"):
        return f"abfs{scheme[4:]}://" + rest.replace(".blob.core.", ".dfs.core.", 1)
    return uri


def file_system(uri: str):
    """pyarrow's file system and path for a folder that Spark knows by this address.

    Tasks write files of a format of their own through it. A folder whose scheme pyarrow has no client for, or whose client isn't
    installed there, as libhdfs for hdfs and viewfs, can't hold such files; the error says so.
    """
    from pyarrow import fs

    try:
        return fs.FileSystem.from_uri(arrow_uri(uri))
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError) as e:
        raise ValueError(f"pyarrow can't write to {uri} ({e}); set spark.checkpoint.dir to a folder on file, s3a, gs, abfss, wasbs or hdfs") from e

"""Where files of the package's own formats can be written."""

import pytest

from winnow.llm.common import arrow_uri, file_system


def test_addresses_are_spelt_as_pyarrow_does():
    same = ["/tmp/a b", "file:/tmp/a", "hdfs://h:1/x", "gs://b/x", "abfss://c@a.dfs.core.windows.net/x", "s3://b/x"]
    assert [arrow_uri(u) for u in same] == same
    assert arrow_uri("s3a://b/x") == arrow_uri("s3n://b/x") == "s3://b/x"
    assert arrow_uri("wasbs://c@a.blob.core.windows.net/x") == "abfss://c@a.dfs.core.windows.net/x" and arrow_uri("wasb://c@a.blob.core.windows.net/x").startswith("abfs://")


def test_other_folders_are_an_error_that_names_them(tmp_path):
    assert file_system(f"file://{tmp_path}")[1] == str(tmp_path)
    with pytest.raises(ValueError, match="nowhere://x"):
        file_system("nowhere://x/y")

"""Scans of folders that are listed and read in tasks."""

from hunkmill.sources import catalog


def test_split_metadata_is_listed_in_tasks(spark, tmp_path):
    def put(name: str, text: str) -> None:
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)

    put("a/metadata_1.json", '{"total_patches": 1,\n "repository": {"name": "r"}}')
    put("a/metadata_2.json", '{"total_patches": 2}')
    put("deep/er/b/metadata_1.json", '{"total_patches": 3, "patches": [{"id": 1}]}')
    put("c/metadata_1.json", "{broken")
    put("c/metadata_2.json", '{"total_patches": 4}')
    put("d/other.json", '{"total_patches": 5}')
    put("_hidden/metadata_1.json", '{"total_patches": 6}')
    got = catalog.split_metadata(spark, str(tmp_path))
    assert sorted((r.split_id, r.total_patches, r.repository and r.repository.name, r.patches and len(r.patches)) for r in got.collect()) == [("a", 1, "r", None), ("b", 3, None, 1), ("c", 4, None, None)]
    # The driver holds the files of listings, not those that are listed.
    assert not any("metadata_" in x for x in got.inputFiles())

"""A Python data source that pages through an issue API.

    spark.dataSource.register(IssueSource)
    spark.read.format("issues").option("slugs", "a,b").load()

One partition per slug; each reads pages of 50 up to the option ``pages`` (four
unless given, ``all`` for no limit), and stops at the last page or at the first
that fails.  The default fetcher reads JSON pages from
files ``{root}/{slug}/{page}.json`` (option ``root``), so the source also works
without a network; a subclass overrides ``fetch`` for a live endpoint.
"""

from __future__ import annotations

import itertools
import json
import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PAGES = 4


class SlugPartition(InputPartition):
    """All pages of one slug."""

    def __init__(self, slug: str) -> None:
        self.slug = slug


class IssueReader(DataSourceReader):
    """Reads the nodes of each slug as JSON text."""

    def __init__(self, options: dict[str, str], fetch) -> None:
        self.slugs = [s.strip() for s in options.get("slugs", "").split(",") if s.strip()]
        self.root = options.get("root", "")
        self.permissive = options.get("mode", "strict") == "permissive"
        pages = options.get("pages", str(PAGES))
        self.pages = None if pages == "all" else int(pages)
        self.fetch = fetch

    def partitions(self) -> list[InputPartition]:
        return [SlugPartition(s) for s in self.slugs]

    def read(self, partition: SlugPartition) -> Iterator[tuple]:
        position = 0
        for page in itertools.count() if self.pages is None else range(self.pages):
            try:
                body = self.fetch(self.root, partition.slug, page)
            except Exception:
                if page == 0 and not self.permissive:
                    raise
                break
            issues = (((body or {}).get("data") or {}).get("repository") or {}).get("issues")
            if not issues:
                break
            for node in issues.get("nodes") or []:
                yield partition.slug, position, json.dumps(node)
                position += 1
            if not (issues.get("pageInfo") or {}).get("hasNextPage"):
                break


class IssueSource(DataSource):
    """``slug, position, node`` where the node is JSON text (see ``tracker.NODE``)."""

    @classmethod
    def name(cls) -> str:
        return "issues"

    def schema(self) -> str:
        return "slug string, position int, node string"

    @staticmethod
    def fetch(root: str, slug: str, page: int) -> dict | None:
        path = os.path.join(root, slug, f"{page}.json")
        if not os.path.exists(path):
            return None
        with open(path, encoding="utf-8") as file:
            return json.load(file)

    def reader(self, schema) -> DataSourceReader:
        return IssueReader(self.options, self.fetch)

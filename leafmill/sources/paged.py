"""Sources of JSON that is fetched: pages that name the next one, and forecasts.

``paged_json``: paging is sequential, so the source has one partition; pages come from a location
(local files or an HTTP address), which keeps the source picklable. Options: ``start`` (the first
page), ``next`` (the field that names the next page, default ``continue``), ``items`` (dotted field
of the list, default ``query.categorymembers``), ``retries`` (default 3). The next page is named by
an address, by a file beside the page, or by an object whose members are sent as parameters of the
first address, in place of those of the same names.

``forecast_json``: one row (place, body) for each place of the comma-separated option ``places``,
fetched from ``address`` with ``{place}`` replaced; a partition for each place. An address that
can't be fetched and a body that is no JSON with a ``list`` are errors, as nothing else is known.
"""

from __future__ import annotations

import json
import os
import time
from collections.abc import Iterator
from urllib.parse import parse_qsl, quote, urlencode, urlparse, urlunparse
from urllib.request import Request, urlopen

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def fetch(address: str, retries: int = 3, wait: float = 0.5, agent: str = "leafmill") -> str:
    """The text at an address or path, bad bytes replaced; a bounded number of attempts."""
    parsed = urlparse(address)
    if parsed.scheme in ("", "file"):
        with open(parsed.path, encoding="utf-8", errors="replace") as f:
            return f.read()
    quoted = urlunparse(parsed._replace(path=quote(parsed.path, safe="/")))
    for attempt in range(retries):
        try:
            with urlopen(Request(quoted, headers={"User-Agent": agent}), timeout=60) as response:
                return response.read().decode("utf-8", "replace")
        except OSError:
            if attempt == retries - 1:
                raise
            time.sleep(wait * 2**attempt)
    raise ValueError("retries must be positive")


def fetch_cached(address: str, folder: str, name: str) -> str:
    """As ``fetch``; what was fetched once is read from the folder."""
    path = os.path.join(folder, name)
    if not os.path.exists(path):
        os.makedirs(folder, exist_ok=True)
        text = fetch(address)
        with open(path + ".part", "w", encoding="utf-8") as f:
            f.write(text)
        os.replace(path + ".part", path)
    with open(path, encoding="utf-8") as f:
        return f.read()


def with_parameters(address: str, members: dict) -> str:
    """The address with the members as parameters of its query; a file's name has none and gives the file of that query."""
    parsed = urlparse(address)
    query = dict(parse_qsl(parsed.query, keep_blank_values=True)) | {k: str(v) for k, v in members.items()}
    return urlunparse(parsed._replace(query=urlencode(query)))


class PagedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def read(self, partition) -> Iterator[tuple]:
        page, seen = self.options.get("start"), set()
        base = os.path.dirname(page or "")
        while page and page not in seen:
            seen.add(page)
            data = json.loads(fetch(page, int(self.options.get("retries", 3))))
            items = data
            for part in self.options.get("items", "query.categorymembers").split("."):
                items = items.get(part, []) if isinstance(items, dict) else []
            for x in items.values() if isinstance(items, dict) else items:
                yield (x.get("pageid"), x.get("ns"), x.get("title"), x.get("fullurl"))
            following = data.get(self.options.get("next", "continue"))
            if isinstance(following, dict):
                page = with_parameters(self.options["start"], following)
            else:
                page = os.path.join(base, following) if following and "://" not in following else following


class PagedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def schema(self) -> str:
        return "pageid bigint, ns int, title string, fullurl string"

    def reader(self, schema) -> PagedReader:
        return PagedReader(dict(self.options))


class ForecastReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p.strip()) for p in self.options["places"].split(",") if p.strip()]

    def read(self, partition) -> Iterator[tuple]:
        body = fetch(self.options["address"].replace("{place}", quote(partition.value)), int(self.options.get("retries", 1)))
        if not isinstance(json.loads(body).get("list"), list):
            raise ValueError(f"no forecast for {partition.value}")
        yield (partition.value, body)


class ForecastSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "forecast_json"

    def schema(self) -> str:
        return "place string, body string"

    def reader(self, schema) -> ForecastReader:
        return ForecastReader(dict(self.options))

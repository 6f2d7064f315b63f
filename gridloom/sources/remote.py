"""Remote services as Spark data sources: image chunks and catalogue searches.

A source's transport is a callable named ``module:function`` in its options, so that tests and
other back ends can stand in for HTTP.  Chunks are fetched by the tasks that hold them, in
partitions of a few chunks each.
"""

from __future__ import annotations

import importlib
import json
import time
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from gridloom.operators.chunks import RETRIED

CHUNK = "row long, col long, w int, h int, xmin double, ymin double, xmax double, ymax double"
FETCHED = f"{CHUNK}, status string, attempts int, error string, content binary"
SCENE = "entityId string, publishDate string, metadata array<struct<fieldName:string,value:string>>"
MAX_RESULTS = 3000  # scenes of one search
MAX_REQUESTS = 50_000  # downloads of one run


@dataclass
class Response:
    code: int
    content_type: str
    body: bytes


def http_get(url: str, params: dict, timeout: float) -> Response:
    from urllib.error import HTTPError
    from urllib.parse import urlencode
    from urllib.request import urlopen

    try:
        with urlopen(f"{url}?{urlencode(params)}", timeout=timeout) as r:
            return Response(r.status, r.headers.get("Content-Type", ""), r.read())
    except HTTPError as e:
        return Response(e.code, e.headers.get("Content-Type", ""), b"")


def blank_get(url: str, params: dict, timeout: float) -> Response:
    """A stand-in for a service without a network: every export is a blank image of the size asked for."""
    import numpy as np

    from gridloom.operators.raster import encode_png

    w, h = map(int, params["size"].split(","))
    return Response(200, "image/png", encode_png(np.zeros((h, w, 3), np.uint8)))


def http_file(url: str, timeout: float) -> tuple[str | None, bytes]:
    """(the name that the server gives, the body) of a file."""
    from urllib.request import urlopen

    with urlopen(url, timeout=timeout) as r:
        return r.headers.get_filename(), r.read()


def http_post(url: str, body: dict, token: str | None, timeout: float) -> Response:
    from urllib.error import HTTPError
    from urllib.request import Request, urlopen

    headers = {"Content-Type": "application/json"} | ({"X-Auth-Token": token} if token else {})
    try:
        with urlopen(Request(url, json.dumps(body).encode(), headers), timeout=timeout) as r:
            return Response(r.status, r.headers.get("Content-Type", ""), r.read())
    except HTTPError as e:
        return Response(e.code, e.headers.get("Content-Type", ""), b"")


def named(transport: str) -> Callable:
    module, _, function = transport.partition(":")
    return getattr(importlib.import_module(module), function)


def export_request(chunk: dict, srs: int, image_format: str, pixel_type: str) -> dict:
    """Parameters of an image export."""
    return {
        "bbox": f"{chunk['xmin']},{chunk['ymin']},{chunk['xmax']},{chunk['ymax']}", "bboxSR": 3857, "imageSR": srs, "size": f"{chunk['w']},{chunk['h']}",
        "format": image_format, "pixelType": pixel_type, "interpolation": "RSP_BilinearInterpolation", "f": "image",
    }


def fetch(get: Callable, url: str, params: dict, retries: int, timeout: float, sleep: Callable[[float], None] = time.sleep) -> tuple[bytes | None, int, str | None]:
    """(body, attempts, error): only busy or broken servers are asked again, with waits of 1, 2, 4 ... 30 seconds."""
    error = None
    for attempt in range(retries + 1):
        try:
            r = get(url, params, timeout)
            if r.code == 200 and r.content_type.lower().startswith("image"):
                return r.body, attempt + 1, None
            error = f"HTTP {r.code} {r.content_type}"
            if r.code not in RETRIED:
                return None, attempt + 1, error
        except OSError as e:
            error = str(e)
        if attempt < retries:
            sleep(min(2.0**attempt, 30.0))
    return None, retries + 1, error


@dataclass
class _Chunks(InputPartition):
    rows: list[tuple]


class _ChunkReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        rows = [tuple(r) for r in json.loads(self.options["chunks"])]
        each = int(self.options.get("batch", "16"))
        return [_Chunks(rows[i : i + each]) for i in range(0, len(rows), each)] or [_Chunks([])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        o = self.options
        get = named(o.get("transport", "gridloom.sources.remote:http_get"))
        names = [c.split()[0] for c in CHUNK.split(", ")]
        for row in partition.rows:
            params = export_request(dict(zip(names, row, strict=True)), int(o.get("srs", "3857")), o.get("format", "tiff"), o.get("pixeltype", "U8"))
            body, attempts, error = fetch(get, o["url"], params, int(o.get("retries", "5")), float(o.get("timeout", "60")))
            yield (*row, "downloaded" if body is not None else "failed", attempts, error, body)


class ImageChunks(DataSource):
    """``format("image_chunks")``: options url, chunks (JSON rows of ``CHUNK``), srs, format, pixelType, retries, timeout, batch, transport."""

    @classmethod
    def name(cls) -> str:
        return "image_chunks"

    def schema(self) -> str:
        return FETCHED

    def reader(self, schema) -> DataSourceReader:
        return _ChunkReader(self.options)


def rolling(work: Callable, items: Iterable, workers: int) -> Iterator:
    """``work`` of every item, in their order; twice as many as ``workers`` are in flight at most, so items of any number stream."""
    with ThreadPoolExecutor(workers) as pool:
        held: deque = deque()
        for item in items:
            held.append(pool.submit(work, item))
            if len(held) >= 2 * workers:
                yield held.popleft().result()
        while held:
            yield held.popleft().result()


def fetch_chunks(chunks: DataFrame, url: str, srs: int = 3857, image_format: str = "tiff", pixel_type: str = "U8", retries: int = 5, timeout: float = 60, transport: str = "gridloom.sources.remote:http_get", per_task: int = 64, workers: int = 4) -> DataFrame:
    """``FETCHED`` rows for a table of chunks of any size: each task fetches its own, ``workers`` at once; a failure is a row."""
    import pandas as pd

    names = [c.split()[0] for c in CHUNK.split(", ")]

    def fetched(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        get = named(transport)

        def one(row) -> pd.DataFrame:
            body, attempts, error = fetch(get, url, export_request(row._asdict(), srs, image_format, pixel_type), retries, timeout)
            return pd.DataFrame([(*row, "downloaded" if body is not None else "failed", attempts, error, body)], columns=[c.split()[0] for c in FETCHED.split(", ")])

        yield from rolling(one, (row for frame in frames for row in frame.itertuples(index=False)), workers)

    tasks = max(1, -(-chunks.count() // per_task))
    return chunks.select(*names).repartition(tasks).mapInPandas(fetched, FETCHED)


class _SceneReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def read(self, partition) -> Iterator[tuple]:
        o = self.options
        client = CatalogueClient(o["url"], named(o.get("transport", "gridloom.sources.remote:http_post")), o.get("token"))
        box = tuple(float(o[k]) for k in ("min_lat", "min_lon", "max_lat", "max_lon"))
        for s in client.scenes(o["dataset"], box, o.get("start"), o.get("end"), int(o.get("maxresults", str(MAX_RESULTS)))):
            yield s["entityId"], s.get("publishDate"), [(m.get("fieldName"), m.get("value")) for m in s.get("metadata", [])]


class CatalogueScenes(DataSource):
    """``format("catalogue_scenes")``: scenes of a dataset in a box and span of dates, at most 3000."""

    @classmethod
    def name(cls) -> str:
        return "catalogue_scenes"

    def schema(self) -> str:
        return SCENE

    def reader(self, schema) -> DataSourceReader:
        return _SceneReader(self.options)


class CatalogueError(RuntimeError):
    pass


class CatalogueClient:
    """A JSON catalogue: log in, search datasets and scenes, ask for downloads, log out.

    A session for ``with``; the token stays with the driver or task that made it.
    """

    def __init__(self, url: str, post: Callable = http_post, token: str | None = None, timeout: float = 60):
        self.url, self.post, self.token, self.timeout = url.rstrip("/"), post, token, timeout
        self.login: tuple[str, str] | None = None

    def __enter__(self) -> CatalogueClient:
        if self.login and not self.token:
            self.token = self.call("login-token", {"username": self.login[0], "token": self.login[1]})
        return self

    def __exit__(self, *_) -> None:
        if self.login and self.token:
            self.call("logout", {})
            self.token = None

    def call(self, what: str, body: dict):
        r = self.post(f"{self.url}/{what}", body, self.token, self.timeout)
        doc = json.loads(r.body or b"{}")
        if r.code in (400, 401, 404) or doc.get("errorCode"):
            raise CatalogueError(f"{what}: {doc.get('errorCode') or r.code} {doc.get('errorMessage', '')}".strip())
        return doc.get("data")

    @staticmethod
    def _box(box: tuple[float, float, float, float]) -> dict:
        lower, upper = ({"latitude": box[i], "longitude": box[i + 1]} for i in (0, 2))
        return {"filterType": "mbr", "lowerLeft": lower, "upperRight": upper}

    def datasets(self, box: tuple[float, float, float, float], name: str | None = None) -> list[dict]:
        return self.call("dataset-search", {"spatialFilter": self._box(box)} | ({"datasetName": name} if name else {})) or []

    def scenes(self, dataset: str, box: tuple[float, float, float, float], start: str | None = None, end: str | None = None, most: int = MAX_RESULTS) -> list[dict]:
        wanted: dict = {"spatialFilter": self._box(box)}
        if start or end:
            wanted["acquisitionFilter"] = {"start": start, "end": end}
        return (self.call("scene-search", {"datasetName": dataset, "maxResults": most, "metadataType": "full", "sceneFilter": wanted}) or {}).get("results", [])

    def options(self, dataset: str, entities: list[str]) -> list[dict]:
        if len(entities) >= MAX_REQUESTS:
            raise ValueError(f"{len(entities)} downloads: a run takes fewer than {MAX_REQUESTS}")
        return self.call("download-options", {"datasetName": dataset, "entityIds": entities}) or []

    def request(self, downloads: list[dict], label: str) -> dict:
        return self.call("download-request", {"downloads": downloads, "label": label}) or {}

    def retrieve(self, label: str) -> dict:
        return self.call("download-retrieve", {"label": label}) or {}


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ImageChunks)
    spark.dataSource.register(CatalogueScenes)


def available_products(options: DataFrame) -> DataFrame:
    return options.where("available")


def ready_downloads(retrieved: DataFrame, requested: DataFrame, seen: DataFrame) -> DataFrame:
    """Downloads that were asked for (new records and duplicates) and aren't handled yet."""
    return retrieved.join(requested.select("downloadId").distinct(), "downloadId", "left_semi").join(seen.select("downloadId"), "downloadId", "left_anti")


def await_downloads(client: CatalogueClient, label: str, wanted: set, sleep: Callable[[float], None] = time.sleep, pause: float = 30.0, rounds: int = 1000) -> Iterator[dict]:
    """Prepared downloads as they come, each once, until all wanted ids are there."""
    seen: set = set()
    for _ in range(rounds):
        for d in client.retrieve(label).get("available", []):
            if d["downloadId"] in wanted and d["downloadId"] not in seen:
                seen.add(d["downloadId"])
                yield d
        if seen >= wanted:
            return
        sleep(pause)
    raise TimeoutError(f"{len(wanted - seen)} downloads were never prepared")


def request_scenes(client: CatalogueClient, dataset: str, entities: list[str], label: str, sleep: Callable[[float], None] = time.sleep) -> Iterator[dict]:
    """Ask for the available product of each scene and give the downloads as they are prepared."""
    products = [{"entityId": o["entityId"], "productId": o["id"]} for o in client.options(dataset, entities) if o.get("available")]
    if not products:
        return
    asked = client.request(products, label)
    wanted = {int(i) for part in ("newRecords", "duplicateProducts") for i in asked.get(part, {})}
    yield from await_downloads(client, label, wanted, sleep)


def file_name(given: str | None, url: str, entity: str) -> str:
    """The file's name: the server's, else the URL's last part, else the scene's; never a path."""
    name = (given or url.partition("?")[0].rpartition("/")[2] or entity).replace("\\", "/").rpartition("/")[2]
    return name if name not in ("", ".", "..") else entity


def fetch_files(downloads: DataFrame, folder: str, attempts: int = 5, timeout: float = 600, transport: str = "gridloom.sources.remote:http_file", workers: int = 5) -> DataFrame:
    """Write the files of ``entityId, url`` into a folder that all executors share: ``entityId, file, error``.

    A task has ``workers`` files in flight; each is asked for ``attempts`` times at most, written aside
    and renamed.  A file that never comes is a row with its error.
    """
    import os

    import pandas as pd

    def fetched(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        get = named(transport)

        def one(row) -> pd.DataFrame:
            error = None
            for _ in range(attempts):
                try:
                    given, body = get(row.url, timeout)
                except OSError as e:
                    error = str(e)
                    continue
                path = os.path.join(folder, file_name(given, row.url, row.entityId))
                with open(aside := f"{path}.{row.entityId}.tmp", "wb") as f:
                    f.write(body)
                os.replace(aside, path)
                return pd.DataFrame([(row.entityId, os.path.basename(path), None)], columns=["entityId", "file", "error"])
            return pd.DataFrame([(row.entityId, None, error)], columns=["entityId", "file", "error"])

        yield from rolling(one, (row for frame in frames for row in frame.itertuples(index=False)), workers)

    os.makedirs(folder, exist_ok=True)
    return downloads.select("entityId", "url").mapInPandas(fetched, "entityId string, file string, error string")


def credentials(path: str = ".env", user: str = "CATALOGUE_USER", token: str = "CATALOGUE_TOKEN") -> tuple[str, str]:
    """User and token, from the environment or else from a file of ``NAME=value`` lines."""
    import os

    found = {}
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            for line in f:
                name, sep, value = line.strip().removeprefix("export ").partition("=")
                if sep and not name.startswith("#"):
                    found[name.strip()] = value.strip().strip("'\"")
    found |= {k: os.environ[k] for k in (user, token) if k in os.environ}
    if missing := [k for k in (user, token) if not found.get(k)]:
        raise ValueError(f"credentials are missing: {', '.join(missing)}")
    return found[user], found[token]


def published_dates(scenes: DataFrame) -> DataFrame:
    return scenes.select("publishDate").where("publishDate IS NOT NULL").distinct().orderBy("publishDate")

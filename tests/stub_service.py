"""An image service for tests: plain TIFFs, and metadata as JSON."""

import json

import numpy as np

from gridloom.sources import remote, tiff


def get(url, params, timeout):
    if params.get("f") == "json":
        extent = {"xmin": -180.0, "ymin": -80.0, "xmax": 180.0, "ymax": 80.0, "spatialReference": {"wkid": 4326}}
        return remote.Response(200, "application/json", json.dumps({"fullExtent": extent, "minPixelSize": 0, "pixelSizeX": 0.3}).encode())
    w, h = map(int, params["size"].split(","))
    x0, y0, x1, y1 = map(float, params["bbox"].split(","))
    rng = np.random.default_rng(1)
    if params["pixelType"] == "F32":
        values = np.full((1, h, w), 5.0, np.float32) + rng.random((1, h, w), np.float32)
    else:
        values = rng.integers(0, 255, (3, h, w), np.uint8)
    return remote.Response(200, "image/tiff", tiff.encode(values, x0, y1, (x1 - x0) / w, (y1 - y0) / h, 3857))


def get_file(url, timeout):
    if "E3" in url:
        raise OSError("broken")
    return ("named.zip" if "E2" in url else None), url.encode()

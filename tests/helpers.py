"""Small arrays to pixel tables and back."""

import numpy as np
import pandas as pd


def pixels(spark, label, value=None, image_set=0, condition="c", **extra):
    label = np.asarray(label)
    y, x = np.indices(label.shape)
    data = {"condition": condition, "image_set": image_set, "y": y.ravel().astype("int32"),
            "x": x.ravel().astype("int32"), "label": label.ravel().astype("int32")}
    if value is not None:
        data["value"] = np.asarray(value).ravel()
    data.update({k: np.asarray(v).ravel() for k, v in extra.items()})
    return spark.createDataFrame(pd.DataFrame(data))


def grid(df, col="label"):
    pdf = df.select("y", "x", col).toPandas()
    out = np.zeros((pdf.y.max() + 1, pdf.x.max() + 1), dtype=pdf[col].dtype)
    out[pdf.y, pdf.x] = pdf[col]
    return out


def blobs(rng, shape=(40, 44), n=9, r=4):
    out = np.zeros(shape, dtype=int)
    yy, xx = np.indices(shape)
    for k in range(1, n + 1):
        cy, cx = rng.integers(0, shape[0]), rng.integers(0, shape[1])
        out[(yy - cy) ** 2 + (xx - cx) ** 2 <= rng.integers(2, r * r)] = k
    return out


def flood(mask, diagonal=False):
    """Component numbers of a boolean array by breadth-first search."""
    steps = [(0, 1), (1, 0), (0, -1), (-1, 0)] + ([(1, 1), (1, -1), (-1, 1), (-1, -1)] if diagonal else [])
    out = np.zeros(mask.shape, dtype=int)
    n = 0
    for y, x in zip(*np.nonzero(mask)):
        if out[y, x]:
            continue
        n += 1
        todo = [(y, x)]
        out[y, x] = n
        while todo:
            a, b = todo.pop()
            for dy, dx in steps:
                p, q = a + dy, b + dx
                if 0 <= p < mask.shape[0] and 0 <= q < mask.shape[1] and mask[p, q] and not out[p, q]:
                    out[p, q] = n
                    todo.append((p, q))
    return out

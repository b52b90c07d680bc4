"""Small images for tests."""

import numpy as np


def tiny_images(spark):
    rows = []
    for k in range(4):
        y, x = np.indices((64, 96))
        rows.append((k, 64, 96, ((x * (k + 1) * 3 + y * 5 + (x * y) % 17 * 4) % 256).astype(float).ravel().tolist()))
    return spark.createDataFrame(rows, "image_id long, h long, w long, pixels array<double>")

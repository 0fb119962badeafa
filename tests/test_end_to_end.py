"""The README's script-to-library guide, run end to end on small files."""

import json
import os

import numpy as np
from pyspark.sql import functions as F

from hanga.operators import catalog as C
from hanga.operators import codebook as CB
from hanga.operators import keypoints as KP
from hanga.operators import learn as LN
from hanga.operators import linear as LIN
from hanga.operators import metrics as M
from hanga.operators import split as SP
from hanga.operators import vectors as V
from hanga.sources import catalogue as SC
from hanga.sources import files as FS


def test_guide_end_to_end(spark, tmp_path):
    rng = np.random.default_rng(0)
    d = str(tmp_path)
    class_dim = spark.createDataFrame([("Artist A", 0), ("Artist B", 1), ("Artist C", 2)],
                                      "class_name string, class_id int")
    # catalogue: 30 images by three allowed artists + noise lines
    lines = [json.dumps({"artist": ["Artist A", "Artist B", "Artist C"][i % 3],
                         "images": [{"path": f"full/img{i:03d}.jpg"}]}) for i in range(30)]
    lines += [json.dumps({"artist": "Someone Else", "images": [{"path": "full/x.jpg"}]}),
              "broken line"]
    with open(os.path.join(d, "catalogue.jl"), "w") as f:
        f.write("\n".join(lines) + "\n")

    # 2. filter + labels
    cat = SC.read_catalogue(spark, os.path.join(d, "catalogue.jl"))
    kept = C.filter_by_class(cat, class_dim)
    labelled = kept.where(C.has_first_image("images")).select(
        C.image_checksum("images").alias("key"), "artist")
    SC.write_label_file(labelled, os.path.join(d, "labels"))
    ok, bad = SC.read_label_file(spark, os.path.join(d, "labels"))
    labels = C.dedup_labels(C.map_to_class(ok, class_dim)[0], "line_order")
    assert labels.count() == 30 and bad.count() == 0

    # 3. keypoint blocks per image: class c's descriptors sit near centre c
    os.mkdir(os.path.join(d, "desc"))
    centres = np.eye(3, 8) * 5
    for i in range(30):
        c = i % 3
        desc = centres[c] + rng.normal(0, 0.3, size=(20, 8))
        block = np.hstack([rng.random((20, 6)), desc])
        np.savez_compressed(os.path.join(d, "desc", f"img{i:03d}.sift.npz"), block)
    kps, unreadable = FS.read_keypoints(spark, os.path.join(d, "desc"), n_dims=8)
    assert unreadable.count() == 0 and kps.count() == 600
    sample = KP.sample(kps, 5, id_cols=["kp_id"], seed=0)
    points = sample.select(F.concat_ws(":", "key", "kp_id").alias("pid"),
                           F.col("desc").alias("features"))
    book, cost, _ = CB.kmeans_codebook(points, 3, max_iter=10, tol=1e-4, attempts=3,
                                       key_col="pid")
    CB.write_codebook(book, os.path.join(d, "codebook"))
    hist = CB.histogram(CB.assign(kps, book), 3)
    FS.write_keyed(hist, os.path.join(d, "bow"))
    done = spark.read.parquet(os.path.join(d, "bow")).select("key")
    assert C.pending(FS.list_files(spark, os.path.join(d, "desc")), done,
                     done_col="key").count() == 0

    # 4. histograms as sample vectors -> statistics and classifier
    vecs = hist.withColumnRenamed("histogram", "features")
    samples = C.join_labels(vecs, labels.drop("n_lines"))
    stats = {r["class_id"]: r for r in V.class_stats(samples, class_dim).collect()}
    assert all(stats[c]["n_samples"] == 10 for c in range(3))
    assert V.knn(samples, "img000", 3).first()["key"] == "img000"
    split = SP.train_test_split(samples, 0.7)
    train = SP.stratified_folds(split.where("split = 'train'"), 3)
    test = split.where("split = 'test'")
    model, report = LIN.fit(train, [0.1, 1.0], 3, n_components=2, width=3,
                            pca_fit_rows=samples)
    path = os.path.join(d, "model")
    model.save(spark, path)
    loaded = LIN.LinearOvRModel.load(spark, path)
    pred = loaded.transform(test).select("key", F.col("class_id").alias("label"), "prediction")
    acc = M.accuracy_summary(M.confusion(pred)).first()
    assert acc["accuracy"] == 1.0
    top = LN.top_weights(loaded.weights(spark), None, 1).collect()
    assert len(top) == 3 and report.count() == 2

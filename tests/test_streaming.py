import json

from rasterlab.plans import views
from rasterlab.plans.analyses import batch_analysis
from rasterlab.streaming.incremental import measure_arrivals


def test_each_image_set_is_measured_once(spark, sf_dir, tmp_path):
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")

    def run():
        q = measure_arrivals(spark, str(inbox), lambda: views.markers(spark, sf_dir),
                             lambda px: batch_analysis(px, ["A", "B"]), out, mark)
        q.awaitTermination(120)
        assert q.exception() is None
        return {(r.ImageSet, r["n"]) for r in spark.read.parquet(out).groupBy("ImageSet").count().withColumnRenamed("count", "n").collect()}

    (inbox / "a.json").write_text(json.dumps({"condition": "c0", "image_set": 0}))
    assert run() == {(0, 300)}
    (inbox / "b.json").write_text("\n".join(
        json.dumps({"condition": f"c{i % 2}", "image_set": i}) for i in (0, 1)))
    assert run() == {(0, 300), (1, 300)}

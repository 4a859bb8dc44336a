from conftest import SF001
from helpers_exports import write_export_files
from oeeforge.plans import jobs
from oeeforge.sources import history as H
from oeeforge.streaming.incremental_load import start_incremental_load


def test_stream_in_micro_batches_equals_batch(spark, tmpdir_path):
    folder = f"{tmpdir_path}/exports"
    write_export_files(spark, SF001, folder)
    hist, log = f"{tmpdir_path}/history", f"{tmpdir_path}/log"
    q = start_incremental_load(spark, folder, hist, log, f"{tmpdir_path}/ckpt", name="t",
                               max_files_per_trigger=10)
    q.awaitTermination(600)
    streamed = H.read_history(spark, hist).select("code_of", "machine", "quality_severity", "source_file")
    batches = H.read_history(spark, hist).select("batch_id").distinct().count()
    assert batches > 1
    batch = jobs.history_view(spark, SF001).select("code_of", "machine", "quality_severity", "source_file")
    streamed = streamed.selectExpr("code_of", "machine", "quality_severity", "regexp_replace(source_file, '[.]parquet$', '') AS source_file")
    assert streamed.count() == batch.count()
    assert streamed.exceptAll(batch).count() == 0

"""Write the production view of a driver scale factor as a folder of export files."""
import os

import pyarrow as pa
import pyarrow.parquet as pq

from oeeforge import schema as S
from oeeforge.sources.production_view import production_view


def write_export_files(spark, sf_dir, folder, fmt="parquet", files=None):
    """One file per source month, columns named with the export labels, in row order."""
    os.makedirs(folder, exist_ok=True)
    view = production_view(spark, sf_dir)
    if files is not None:
        view = view.filter(view[S.SOURCE_FILE].isin(files))
    pdf = view.orderBy(S.SOURCE_FILE, S.ROW_INDEX).toPandas()
    written = []
    for name, part in pdf.groupby(S.SOURCE_FILE, sort=True):
        out = part[S.DATA_COLUMNS].rename(columns={n: S.LABEL[n] for n in S.DATA_COLUMNS}).reset_index(drop=True)
        path = os.path.join(folder, f"{name}.{fmt}")
        if fmt == "parquet":
            pq.write_table(pa.Table.from_pandas(out, preserve_index=False), path)
        else:
            out.to_csv(path, index=False)
        written.append(name)
    return written

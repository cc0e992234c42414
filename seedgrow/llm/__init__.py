"""Operations of a large-scale training-data pipeline.

One module per operator; ``queries`` holds the registered queries. Nothing
else in the library imports this subpackage.

Conventions shared by every operator:

* it reads only the columns it names, so further columns (also with clashing
  names) neither break it nor change its result; an output column replaces an
  input column of the same name; internal columns start with ``__sg_``;
* state that must survive a lost executor is written as parquet under the
  folder in ``spark.checkpoint.dir`` (``common.Scratch``), never kept on one
  executor's disk.
"""

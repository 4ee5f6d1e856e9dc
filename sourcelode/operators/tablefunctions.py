"""Detectors as table functions, to be called by name in SQL."""

from pyspark.sql import SparkSession, functions as F, types as T

from sourcelode.schemas import FINDINGS

_PLACES = ("line_number", "column_number", "end_line_number", "end_column_number")


def detector_shape() -> T.StructType:
    return T.StructType([*FINDINGS.fields, T.StructField("detector", T.StringType()), T.StructField("error", T.StringType())])


def register_detector(spark: SparkSession, name: str, check, languages=()):
    """Make ``check(code, file_path, language)``, which yields dicts of finding fields, a table function ``name``::

        SELECT f.repo, d.* FROM files f, LATERAL name(f.content, f.file_path, f.language) d

    Rows move through Arrow. An error in a file gives a row with the detector's name and the ``error``; what was found in that
    file before it, and all other files, stay. ``languages`` (all, if empty) decides for which files ``check`` is
    called. Returns the function, for the DataFrame API.
    """
    shape, wanted = detector_shape(), frozenset(languages)
    names = [field.name for field in FINDINGS.fields]

    @F.udtf(returnType=shape, useArrow=True)
    class Detector:
        def eval(self, content: str, file_path: str, language: str):
            import hashlib

            if content is None or wanted and language not in wanted:
                return
            try:
                for finding in check(content, file_path, language):
                    row = {"file_path": file_path, **finding}
                    place = [row.get("file_path"), row.get("vulnerability_type"), *(row.get(c) for c in _PLACES)]
                    joined = "|".join(str(part) for part in place if part is not None)
                    row.setdefault("id", hashlib.sha256(joined.encode()).hexdigest())
                    yield (*(row.get(c) for c in names), name, None)
            except Exception as error:
                lost = {"file_path": file_path}
                yield (*(lost.get(c) for c in names), name, f"{type(error).__name__}: {error}")

    spark.udtf.register(name, Detector)
    return Detector

"""Code features as an ML stage, so that one saved pipeline holds everything a classifier needs."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame

from siftline.operators.features import PROFILES, TfidfModel, assemble_features, with_ast_features


def code_features(
    df: DataFrame, code: str, tfidf: TfidfModel, with_ast: bool, ast: str | None = None, into: str = "features"
) -> DataFrame:
    """Add the vector a classifier reads. ``ast`` names syntax features that ``df`` holds, so nothing is parsed."""
    if not with_ast:
        return tfidf.vector(df, code, into)
    weighted = tfidf.vector(df, code)
    if ast is not None:
        return assemble_features(weighted, ast=ast, into=into).drop("tfidf")
    return assemble_features(with_ast_features(weighted, code), into=into).drop("tfidf", "ast")


class CodeFeatures(Transformer, HasInputCol, HasOutputCol, MLWritable, MLReadable):
    """Tokens, TF-IDF weights and, ``with_ast``, syntax features of the input column as one vector.

    Saved as ML stages are: parameters and settings as metadata, the vocabulary as
    Parquet beside it. A pipeline with it loads in any session that can import this package.
    """

    @keyword_only
    def __init__(self, *, tfidf: TfidfModel | None = None, with_ast: bool = False, inputCol: str = "code", outputCol: str = "features"):
        super().__init__()
        self.tfidf, self.with_ast = tfidf, with_ast
        self._set(inputCol=inputCol, outputCol=outputCol)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return code_features(dataset, self.getInputCol(), self.tfidf, self.with_ast, into=self.getOutputCol())

    def write(self) -> MLWriter:
        return _FeaturesWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _FeaturesReader()


class _FeaturesWriter(MLWriter):
    def __init__(self, stage: CodeFeatures):
        super().__init__()
        self.stage = stage

    def saveImpl(self, path: str) -> None:
        tfidf = self.stage.tfidf
        if PROFILES.get(tfidf.profile.name) != tfidf.profile:
            raise ValueError(f"profile {tfidf.profile.name} is not one of {sorted(PROFILES)}, so it could not be loaded again")
        settings = {"profile": tfidf.profile.name, "documents": tfidf.documents, "withAst": self.stage.with_ast}
        DefaultParamsWriter.saveMetadata(self.stage, path, self.sparkSession, extraMetadata=settings)
        tfidf.terms_table(self.sparkSession).coalesce(1).write.parquet(f"{path}/vocabulary")


class _FeaturesReader(MLReader):
    def load(self, path: str) -> CodeFeatures:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        vocabulary = self.sparkSession.read.parquet(f"{path}/vocabulary").orderBy("idx").toArrow()
        tfidf = TfidfModel(PROFILES[metadata["profile"]], metadata["documents"], vocabulary)
        stage = CodeFeatures(tfidf=tfidf, with_ast=metadata["withAst"])
        stage._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(stage, metadata)
        return stage

"""Readers with explicit schemas: parquet tables, JSON logs and sidecars, base64 galleries, parameters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, BinaryType, FloatType

TRACKS = "frame_n bigint, player_id bigint, team string, px bigint, py bigint, match_id bigint"
DETECTION_LINE = "match_id bigint, frame_n bigint, detections array<struct<class_id:int,x:double,y:double,conf:double>>"
EVENT_LOG = "ts double, type string, source string, team string, player string, x double, y double"
TAGS = "video string, events array<struct<timestamp_ms:bigint,event_type:string,team:string,note:string>>"
SHOTS = "match_id bigint, frame_n bigint, player_id bigint, gk_id bigint, team string, number bigint, zone string, cell string, outcome string"
GALLERY = "vec_id bigint, player_id bigint, vec array<float>"
GALLERY_B64 = "player_id bigint, samples array<struct<vec_id:bigint,data:string>>, data string, vec_id bigint"


def read_tracks(spark: SparkSession, path: str) -> DataFrame:
    """Track rows partitioned by match_id: a match filter prunes whole folders."""
    return spark.read.schema(TRACKS).parquet(path)


def read_detections(spark: SparkSession, path: str) -> DataFrame:
    """One JSON line per frame, one row per detection."""
    d = spark.read.schema(DETECTION_LINE).json(path)
    return d.select("match_id", "frame_n", F.explode("detections").alias("d")).select("match_id", "frame_n", "d.*")


def read_event_log(spark: SparkSession, path: str, json_array: bool = False) -> DataFrame:
    """Event log as JSON lines (splittable) or, per match file, as one JSON array."""
    return spark.read.schema(EVENT_LOG).option("multiLine", json_array).json(path)


def read_tags(spark: SparkSession, path: str) -> DataFrame:
    """Sidecar files {video, events[]}: one row per tag, in time order per video."""
    d = spark.read.schema(TAGS).json(path)
    return d.select("video", F.explode("events").alias("e")).select("video", "e.*").sort("video", "timestamp_ms")


def read_shots(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SHOTS).json(path)


def read_gallery(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(GALLERY).parquet(path)


@F.pandas_udf(ArrayType(FloatType()))
def decode_floats(raw: pd.Series) -> pd.Series:
    """Little-endian float32 bytes to an array, a batch at a time."""
    return raw.map(lambda b: None if b is None else np.frombuffer(b, dtype="<f4"))


@F.pandas_udf(BinaryType())
def encode_floats(vec: pd.Series) -> pd.Series:
    return vec.map(lambda v: None if v is None else np.asarray(v, dtype="<f4").tobytes())


def read_gallery_b64(spark: SparkSession, path: str) -> DataFrame:
    """Base64 float32 galleries in two layouts: a list of samples, or one vector per line."""
    d = spark.read.schema(GALLERY_B64).json(path)
    many = d.filter("samples is not null").select("player_id", F.explode("samples").alias("s")).select("player_id", "s.vec_id", "s.data")
    one = d.filter("samples is null").select("player_id", "vec_id", "data")
    return many.unionByName(one).select("vec_id", "player_id", decode_floats(F.unbase64("data")).alias("vec"))


def flat_params(tree: dict, prefix: str = "") -> Iterator[tuple[str, str]]:
    for k, v in tree.items():
        if isinstance(v, dict):
            yield from flat_params(v, f"{prefix}{k}.")
        else:
            yield f"{prefix}{k}", str(v)


def params_frame(spark: SparkSession, tree: dict) -> DataFrame:
    """A nested parameter dict as (key path, value) rows; a few hundred at most."""
    return spark.createDataFrame(list(flat_params(tree)), "key string, value string")

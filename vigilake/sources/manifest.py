"""The standard scene manifest of the CDnet 2014 data set, and reading one's own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "category string, scene string, night boolean, sample_rate_override int, ord int"

# Category, scene, night flag and own sample rate of each scene, in report order.
SCENES = (
    ("baseline", "highway", False, None),
    ("badWeather", "blizzard", False, None),
    ("badWeather", "skating", False, None),
    ("badWeather", "snowFall", False, None),
    ("badWeather", "wetSnow", False, None),
    ("shadow", "backdoor", False, None),
    ("shadow", "bungalows", False, None),
    ("shadow", "busStation", False, None),
    ("shadow", "copyMachine", False, None),
    ("shadow", "cubicle", False, None),
    ("shadow", "peopleInShade", False, None),
    ("dynamicBackground", "boats", False, None),
    ("dynamicBackground", "canoe", False, None),
    ("dynamicBackground", "fall", False, None),
    ("dynamicBackground", "fountain01", False, None),
    ("dynamicBackground", "fountain02", False, None),
    ("dynamicBackground", "overpass", False, None),
    ("intermittentObjectMotion", "abandonedBox", False, None),
    ("intermittentObjectMotion", "parking", False, None),
    ("intermittentObjectMotion", "sofa", False, None),
    ("intermittentObjectMotion", "streetLight", False, None),
    ("intermittentObjectMotion", "tramstop", False, None),
    ("intermittentObjectMotion", "winterDriveway", False, None),
    ("lowFramerate", "port_0_17fps", False, 5),
    ("lowFramerate", "tramCrossroad_1fps", False, 5),
    ("lowFramerate", "tunnelExit_0_35fps", False, 5),
    ("lowFramerate", "turnpike_0_5fps", False, 5),
    ("cameraJitter", "badminton", False, None),
    ("cameraJitter", "boulevard", False, None),
    ("cameraJitter", "sidewalk", False, None),
    ("cameraJitter", "traffic", False, None),
    ("turbulence", "turbulence0", False, None),
    ("turbulence", "turbulence1", False, None),
    ("turbulence", "turbulence2", False, None),
    ("turbulence", "turbulence3", False, None),
    ("nightVideos", "bridgeEntry", True, None),
    ("nightVideos", "busyBoulvard", True, None),
    ("nightVideos", "fluidHighway", True, None),
    ("nightVideos", "streetCornerAtNight", True, None),
    ("nightVideos", "tramStation", True, None),
    ("nightVideos", "winterStreet", True, None),
    ("thermal", "corridor", False, None),
    ("thermal", "diningRoom", False, None),
    ("thermal", "lakeSide", False, None),
    ("thermal", "library", False, None),
    ("thermal", "park", False, None),
)


def standard_manifest(spark: SparkSession) -> DataFrame:
    """46 scenes with night flag and, for the clips of few frames, a sample rate of their own."""
    return spark.createDataFrame([(*row, i) for i, row in enumerate(SCENES)], SCHEMA)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A manifest from CSV files with a header."""
    return spark.read.schema(SCHEMA).option("header", True).csv(path)

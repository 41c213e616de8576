"""Names and fixed values shared by every operator."""

# --- column groups ---------------------------------------------------------

#: Spectral bands in matrix order (channel 0..11). Fixed values.
BANDS = [
    "coastal", "blue", "green", "red", "rededge1", "rededge2", "rededge3",
    "nir", "nir08", "nir09", "swir16", "swir22",
]
#: Derived index channels 12..15. Fixed values.
INDICES = ["ndvi", "evi", "ndwi", "ndbi"]
CHANNELS = BANDS + INDICES
#: Assets in sampling order: the mask layer comes before the bands.
ASSETS = ["scl"] + BANDS
#: One pixel of one year. Every series operator groups by these.
SERIES = ["bbox", "year", "lon", "lat", "CDL"]
#: A place, whatever the year.
PIXEL = ["lon", "lat"]
#: One stored scene.
SCENE = ["bbox", "year", "tile", "scene_date"]

# --- scene classification layer: fixed values -------------------------------

SCL_NAMES = {
    0: "No Data",
    1: "Saturated or defective pixel",
    2: "Topographic casted shadows",
    3: "Cloud shadows",
    4: "Vegetation",
    5: "Not-vegetated",
    6: "Water",
    7: "Unclassified",
    8: "Cloud medium probability",
    9: "Cloud high probability",
    10: "Thin cirrus",
    11: "Snow or ice",
}
SCL_DROP = [0, 1, 7, 8, 9, 11]
SCL_VEGETATION = 4

# --- label scheme: fixed values ---------------------------------------------

TARGETED_CROPS = ["Soybeans", "Rice", "Corn", "Cotton"]
OTHER_CROPS = [
    "Other Hay/Non Alfalfa", "Pop or Orn Corn", "Peanuts", "Sorghum", "Oats",
    "Peaches", "Clover/Wildflowers", "Pecans", "Sod/Grass Seed", "Other Crops",
    "Dry Beans", "Winter Wheat", "Alfalfa", "Potatoes", "Peas", "Herbs", "Rye",
    "Cantaloupes", "Sunflower", "Watermelons", "Sweet Corn", "Sweet Potatoes",
]
BASE_LABELS = ["Uncultivated", "Cultivated", "No Crop Growing"]
LEGEND = BASE_LABELS + TARGETED_CROPS
UNCULTIVATED, CULTIVATED, NO_CROP = 0, 1, 2
DOUBLE_CROP_MARK = "Dbl"

# --- class profile word lists: fixed values ---------------------------------

NON_CROP_CLASSES = [
    "Background", "Open Water", "Developed/Open Space", "Developed/Low Intensity",
    "Developed/Med Intensity", "Developed/High Intensity", "Barren",
    "Deciduous Forest", "Evergreen Forest", "Mixed Forest", "Shrubland",
    "Grass/Pasture", "Woody Wetlands", "Herbaceous Wetlands", "Aquaculture",
    "Fallow/Idle Cropland", "Clouds/No Data", "Nonag/Undefined",
]
COMMON_OTHER_CROPS = [
    "Other Hay/Non Alfalfa", "Alfalfa", "Other Crops", "Clover/Wildflowers",
    "Sod/Grass Seed", "Herbs", "Misc Vegs & Fruits",
]
#: Display order of class names in maps; the position is the display code.
DISPLAY_CLASSES = [
    "Peanuts", "Rice", "Other Hay/Non Alfalfa", "Winter Wheat", "Corn",
    "Developed/Med Intensity", "Developed/Open Space", "Fallow/Idle Cropland",
    "Developed/Low Intensity", "Dbl Crop WinWht/Soybeans", "Background", "Cotton",
    "Soybeans", "Herbaceous Wetlands", "Woody Wetlands", "Grass/Pasture",
    "Open Water", "Pop or Orn Corn", "Oats", "Developed/High Intensity",
    "Aquaculture", "Deciduous Forest", "Sunflower", "Pecans",
]

# --- scene metadata: fixed values -------------------------------------------

COVERAGE_KEYS = [
    "s2:vegetation_percentage",
    "s2:not_vegetated_percentage",
    "s2:thin_cirrus_percentage",
    "s2:cloud_shadow_percentage",
    "s2:dark_features_percentage",
]
COVERAGE_MIN = 30

# --- windows ----------------------------------------------------------------

#: Window end days run 0, 15, ..., 195 and 200.
SWEEP_START_DAYS = list(range(0, 200, 15)) + [200]
DAYS_IN_SERIES = 120
DAYS_PER_BUCKET = 5
FRAMES_TO_CHECK = 2
DAY_CLIP = 365

#: Window configurations compared by the configuration sweep. Fixed values:
#: (name, days_in_series, days_per_bucket, frames_to_check, strategy).
SWEEP_CONFIGS = [
    ("baseline", 120, 5, 3, "deterministic"),
    ("short_series", 90, 5, 3, "deterministic"),
    ("long_series", 150, 5, 3, "deterministic"),
    ("very_long_series", 180, 5, 3, "deterministic"),
    ("early_season", 120, 5, 3, "early_season"),
    ("mid_season", 120, 5, 3, "mid_season"),
    ("late_season", 120, 5, 3, "late_season"),
    ("lenient_scl", 120, 5, 1, "deterministic"),
    ("strict_scl", 120, 5, 5, "deterministic"),
    ("very_strict_scl", 120, 5, 7, "deterministic"),
    ("small_buckets", 120, 3, 3, "deterministic"),
    ("large_buckets", 120, 10, 3, "deterministic"),
    ("very_small_buckets", 120, 2, 3, "deterministic"),
    ("mid_season_lenient", 120, 5, 1, "mid_season"),
    ("mid_season_strict", 120, 5, 5, "mid_season"),
    ("long_mid_season", 150, 5, 3, "mid_season"),
]

# --- scoring ----------------------------------------------------------------

HIGH_CONFIDENCE = 0.8
IMBALANCE_SHARE = 0.1
PROB_EPSILON = 1e-7


def buckets_in(days_in_series: int, days_per_bucket: int) -> int:
    """Rows of a bucketed matrix."""
    return days_in_series // days_per_bucket + 1

"""Schemas of the relations that sources produce and operators take. Times are UTC without zone."""

STATION = (
    "name string, alternate_names array<string>, id string, public_id string, region string, location string, "
    "lat double, lon double, url string, provider string, bid string, depth double, kind string, ord long"
)
TIDE_EVENT = "station_id string, type string, units string, prediction double, time timestamp_ntz, url string"
CURRENT_EVENT = (
    "bid string, bin string, type string, mean_flood_dir string, mean_ebb_dir string, time timestamp_ntz, "
    "depth string, velocity_major double, url string"
)
CONSTITUENT = "name string, v array<double>, u array<double>, f_formula int, speed double"
HARMONIC_STATION = (
    "id string, bid string, name string, lat double, lon double, region string, units string, type string, "
    "datum double, meridian double, constituents array<struct<name: string, amp: double, phase: double>>, depth double, ord long"
)
LUNAR_PHASE = "ts timestamp_ntz, type string"

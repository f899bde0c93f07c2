"""Table schemas and the fixed values of the monitoring domain."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _D = T.StringType(), T.DoubleType()


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


SAMPLES = _struct(
    ("type", _S), ("county", _S), ("waterbody", _S), ("station", _S), ("date", T.DateType()),
    ("parameter", _S), ("location", _S), ("units", _S), ("val", _D), ("notes", _S),
)
STATIONS = _struct(
    ("waterbody", _S), ("station", _S), ("name", _S), ("WBID", _S), ("WATERBODY_NAME", _S),
    ("datestr", T.DateType()), ("dateend", T.DateType()), ("lon", _D), ("lat", _D),
)
RING = T.ArrayType(_struct(("x", _D), ("y", _D)))
REGIONS = _struct(
    ("WBID", _S), ("WATERBODY_NAME", _S), ("rings", T.ArrayType(RING)),
    ("xmin", _D), ("ymin", _D), ("xmax", _D), ("ymax", _D),
)
RAIN = _struct(("station", _S), ("name", _S), ("date", T.DateType()), ("precip_inches", _D))
GAUGES = _struct(
    ("station", _S), ("name", _S), ("WBID", _S), ("WATERBODY_NAME", _S), ("lon", _D), ("lat", _D)
)
CATALOGUE = _struct(
    ("type", _S), ("units", _S), ("location", _S), ("parameter", _S),
    ("datestr", T.DateType()), ("dateend", T.DateType()), ("label", _S), ("labelnouni", _S),
)
CRITERIA = _struct(
    ("waterbody", _S), ("station", _S), ("WBID", _S), ("parameter", _S), ("value", _D)
)
CONTINUOUS = _struct(
    ("waterbody", _S), ("station", _S), ("timestamp", T.TimestampType()), ("temp_f", _D), ("sal_ppt", _D)
)

TABLES = {
    "samples": SAMPLES, "stations": STATIONS, "regions": REGIONS, "rain": RAIN, "gauges": GAUGES,
    "rain_regions": REGIONS, "catalogue": CATALOGUE, "criteria": CRITERIA, "continuous": CONTINUOUS,
}

# --- fixed values: source formats and word lists the results depend on ------------------------

NULL_TOKENS = ("NA", "", ".")

FIELD_IDS = ("county", "waterbody", "station", "date")
FIELD_HEADINGS = ("County", "Water Body", "Station Number", "Date (Month/Day/Year)")
LAB_HEADINGS = ("County", "Lake", "Date", "Station", "Secchi (ft)", "Secchi 2", "TP (µg/L)", "TN (µg/L)", "Cond (µS/cm)", "Cond (mS/cm)")

FIELD_RENAMES = {
    "water_body": "waterbody",
    "station_number": "station",
    "date_month_day_year": "date",
    "time_24hr": "time",
    "temperature_surface_f": "temp_surf_f",
    "temperature_bottom_f": "temp_bott_f",
    "dissolved_oxygen_percent_surface_percent_sat": "dosat_surf_psat",
    "dissolved_oxygen_percent_bottom_percent_sat": "dosat_bott_psat",
    "dissolved_oxygen_surface_mg_l": "do_surf_mgl",
    "dissolved_oxygen_bottom_mg_l": "do_bott_mgl",
    "specific_conductivity_m_s_cm_surface": "cond_surf_mscm",
    "specific_conductivity_m_s_cm_bottom": "cond_bott_mscm",
    "salinity_surface_ppt": "sal_surf_ppt",
    "salinity_bottom_ppt": "sal_bott_ppt",
    "p_h_surface": "ph_surf_su",
    "p_h_bottom": "ph_bott_su",
    "turbidity_surface_ntu": "turb_surf_ntu",
    "turbidity_bottom_ntu": "turb_bott_ntu",
    "depth_surface_ft": "depth_surf_ft",
    "depth_bottom_ft": "depth_bott_ft",
}
LAB_RENAMES = {
    "lake": "waterbody",
    "tp_mg_l": "tp_mgl",
    "tn_mg_l": "tn_mgl",
    "chl_mg_l_uncorrected": "chluncorr_ugl",
    "chl_mg_l_corrected": "chlcorr_ugl",
    "secchi_2": "secchi_onbott",
    "color_pt_co_units": "color_ptco",
    "cond_m_s_cm": "cond_uscm",
    "cond_m_s_cm_2": "cond_mscm",
}
LAB_IDS = ("county", "waterbody", "date", "month", "day", "year", "station", "secchi_onbott")
CALENDAR_COLUMNS = ("month", "day", "year", "time")

STATION_RENAMES = {
    "CBA Waterbody Name": "waterbody",
    "CBA Station #": "station",
    "Monitoring Location Name": "name",
    "WBID": "WBIDorig",
    "Latitude": "lon",  # the sheet's two coordinate headers are swapped
    "Longitude": "lat",
}
CRITERIA_RENAMES = {
    "CBA Waterbody Name": "waterbody",
    "CBA Station #": "station",
    "WBID": "WBID",
    "Total Phosphorus (mg/L)": "tp",
    "Total Nitrogen (mg/L)": "tn",
    "Chlorophyll a (μg/L)": "chl",
}
CRITERIA_PARAMETERS = ("tp", "tn", "chl")

COUNTY_RECODE = {"okaloosa": "Okaloosa", "walton": "Walton"}
CRITERIA_REGION_RECODE = {"959F": "959C", "46": "49F"}

# applied in this order
WATERBODY_FIXES = (
    ("creek", "Creek"),
    ("beach", "Beach"),
    (r"FT\.", "Ft."),
    ("GAP", "Gap"),
    ("walton", "Walton"),
    ("Tky", "TKY"),
    ("Redfish", "Red Fish"),
    ("Cba", "CBA"),
    (r"^Bass\sLake$", "Bass"),
)
LAB_WATERBODY_FIXES = ((r"^CBA\sGAP", "CBA Gap"),)

LAB_JUNK = r"broken|bottle|No water sample or Data sheet only Chl\.|Not Reported|_"
DEPTH_NOTE_JUNK = r"^.*\(|\).*$|Weeds|Bottom|Not Reported|^S$"
ON_BOTTOM = "Weeds|Bottom"
ON_BOTTOM_NOTE = "on bottom"

# parameter, units it applies to (None = any), label, label without unit
PARAMETER_LABELS = (
    ("temp", None, "Temperature (F)", "Temperature"),
    ("dosat", None, "Dissolved Oxygen (% Sat)", "Dissolved Oxygen (%)"),
    ("do", "mgl", "Dissolved Oxygen (mg/L)", "Dissolved Oxygen"),
    ("cond", None, "Conductivity (mS/cm)", "Conductivity"),
    ("sal", None, "Salinity (ppt)", "Salinity"),
    ("ph", None, "pH (su)", "pH"),
    ("turb", None, "Turbidity (NTU)", "Turbidity"),
    ("secchi", None, "Secchi Depth (ft)", "Secchi Depth"),
    ("chlcorr", None, "Chl-a Corrected (ug/L)", "Chl-a Corrected"),
    ("chluncorr", None, "Chl-a Uncorrected (ug/L)", "Chl-a Uncorrected"),
    ("tp", None, "Total Phosphorus (mg/L)", "Total Phosphorus"),
    ("tn", None, "Total Nitrogen (mg/L)", "Total Nitrogen"),
    ("color", None, "Color (pt-co)", "Color"),
    ("depth", None, "Depth (ft)", "Depth"),
)
LOCATIONS = (("surf", "Surface"), ("bott", "Bottom"))
RAIN_MAP_LABEL = "Mean monthly rainfall (inches)"
RAIN_SERIES_LABEL = "Cumulative rainfall (inches)"

RAIN_STATION_PREFIX = "^GHCND:"
RAIN_STATIONS = {
    "USC00086240": "Niceville",
    "USW00013884": "Crestview",
    "USC00013251": "Geneva",
}
RAIN_STATION_COORDS = (  # station, latitude, longitude
    ("USC00013251", 31.0383, -85.8708),
    ("USC00086240", 30.5317, -86.4928),
    ("USW00013884", 30.7772, -86.5194),
)

# --- fixed values: expectations of the data-quality checks ------------------------------------

FIRST_SAMPLE_DATE = "1992-11-08"
FIRST_RAIN_DATE = "1990-01-01"
STATION_BOX = {"xmin": -86.78747, "ymin": 30.2815, "xmax": -85.68101, "ymax": 31.10925}
COUNTIES = ("Bay", "Holmes", "Okaloosa", "Walton", "Washington")
REGION_IDS = (
    "959H", "959E", "786A", "959I", "1027A", "959A", "906D", "917", "778B", "778C", "731", "778D",
    "789", "843", "917A", "778A", "786", "915", "843A", "59D", "49C", "712", "722", "692", "49B",
    "679", "570", "49", "49F", "881A", "742", "957", "944", "937", "495A", "1040A", "959D", "1037",
    "959G", "1009A", "959J", "959", "959C", "1055A", "568A", "959B", "568", "1040D",
)
GAUGE_REGION_IDS = ("644", "160B")
STATIONS_WITHOUT_REGION = 2
GAUGES_WITHOUT_REGION = 1
WATERBODIES = (
    "Allen", "Alligator", "Bass", "Big Red Fish", "Camp Creek", "Campbell", "CBA Destin-1", "CBA Destin-2",
    "CBA Destin-3", "CBA Destin-4", "CBA Destin-5", "CBA Destin-6", "CBA Destin-7", "CBA Destin-8",
    "CBA Freeport-1", "CBA Freeport-10", "CBA Freeport-2", "CBA Freeport-3", "CBA Freeport-4",
    "CBA Freeport-5", "CBA Freeport-6", "CBA Freeport-7", "CBA Freeport-8", "CBA Freeport-9",
    "CBA Ft. Walton Beach-1", "CBA Ft. Walton Beach-10", "CBA Ft. Walton Beach-16",
    "CBA Ft. Walton Beach-19", "CBA Ft. Walton Beach-2", "CBA Ft. Walton Beach-3",
    "CBA Ft. Walton Beach-4", "CBA Ft. Walton Beach-5", "CBA Ft. Walton Beach-6",
    "CBA Ft. Walton Beach-7", "CBA Ft. Walton Beach-8", "CBA Ft. Walton Beach-9", "CBA Gap-1",
    "CBA Gap-2", "CBA Gap-3", "CBA Holmes Creek-1", "CBA Holmes Creek-2", "CBA Holmes Creek-3",
    "CBA Mullet Creek-1", "CBA Mullet Creek-2", "CBA Mullet Creek-3", "CBA Niceville-1",
    "CBA Niceville-10", "CBA Niceville-2", "CBA Niceville-3", "CBA Niceville-4", "CBA Niceville-5",
    "CBA Niceville-6", "CBA Niceville-7", "CBA Niceville-8", "CBA Niceville-9", "CBA Pea River-1",
    "CBA River-3", "CBA River-4", "CBA River-5", "CBA River-7", "CBA River-8", "CBA River-9",
    "CBA Santa Rosa Beach-1", "CBA Santa Rosa Beach-10", "CBA Santa Rosa Beach-2",
    "CBA Santa Rosa Beach-3", "CBA Santa Rosa Beach-4", "CBA Santa Rosa Beach-5",
    "CBA Santa Rosa Beach-6", "CBA Santa Rosa Beach-7", "CBA Santa Rosa Beach-8",
    "CBA Santa Rosa Beach-9", "CBA Santa Rosa Sound-1", "CBA Santa Rosa Sound-2",
    "CBA Santa Rosa Sound-3", "CBA Santa Rosa Sound-4", "CBA Santa Rosa Sound-5",
    "CBA Santa Rosa Sound-6", "CBA Santa Rosa Sound-7", "CBA Santa Rosa Sound-8", "CBA TKY-1",
    "CBA TKY-2", "CBA TKY-3", "Deer", "Draper", "Eastern", "Eastern North", "Fuller", "Grayton",
    "Little Red Fish", "Morris", "Oyster", "Powell", "Roberts", "Stallworth", "Swift Creek-1",
    "Swift Creek-2", "Swift Creek-3", "Swift Creek-4", "Tresca", "Western", "Western Northeast",
)

# --- fixed values: Student t, upper 2.5 % points for 1..30 degrees of freedom ------------------

T_975 = (
    12.7062047362, 4.3026527297, 3.1824463053, 2.7764451052, 2.5705818356, 2.4469118511,
    2.3646242516, 2.3060041352, 2.2621571628, 2.228138852, 2.2009851601, 2.1788128297,
    2.1603686565, 2.1447866879, 2.1314495456, 2.1199052992, 2.1098155778, 2.1009220402,
    2.0930240544, 2.0859634473, 2.0796138447, 2.0738730679, 2.0686576104, 2.0638985616,
    2.0595385528, 2.0555294386, 2.0518305165, 2.0484071418, 2.0452296421, 2.0422724563,
)
Z_975 = 1.959963984540054

"""Thresholds and units that results depend on."""

INTERVAL_S, HOUR_S, WATCHDOG_S = 300, 3600, 30
COVERAGE_EXACT, COVERAGE_PARTIAL, NIGHT_ELEVATION = 0.95, 0.80, 3.0
LOWER_BOUND_WEIGHT, RECONSTRUCTED_WEIGHT = 0.5, 0.35
BINDING_AT, BINDING_PHYSICS, BATTERY_MARGIN = 0.97, 1.05, 1.10
EMA_HALF_LIFE, SHRINK_K, EFFECT_CLAMP, TOTAL_CLAMP = 15, 10.0, 0.7, 1.4
RATIO_LOW, RATIO_HIGH = 0.05, 5.0
AZ_BIN, EL_BIN, CELL_WEIGHT, CELL_QUANTILE, REFERENCE_QUANTILE, CELL_K = 10, 5, 4.0, 0.80, 0.90, 6.0
JOINT_EPOCHS, LEGACY_BEAM, SHADE_LOW = 50, 0.5, 0.05
SEASON_DELTA, SEASON_DAYS = 0.18, 10
SKY_RECENCY_DAYS, CURVE_RECENCY_DAYS = 730.0, 365.0
LOAD_BUCKETS = [2, 5, 10, 20, 35, 50, 75, 100]
CURVE_CAP, CURVE_MIN_SAMPLES = 0.05, 50.0
CEILING_MARGIN, CEILING_ALBEDO, CEILING_CAP, CEILING_ELEVATION = 1.15, 0.90, 1400.0, 5.0
ALBEDO, TEMP_COEFF, SYSTEM_EFF = 0.20, -0.004, 0.90
RAW_DAYS, ISSUE_DAYS, SHADING_DAYS, THIN_DAYS = 90, 35, 730, 120
ANNUAL_SHARE, AMORTISATION_MONTHS = 0.05, 1200
LABEL_SHIFT_S = -3600
#: SAPM (a, b, delta T) by mounting.
MOUNTS = {"open_rack_glass_glass": (-3.47, -0.0594, 3.0), "close_mount_glass_glass": (-2.98, -0.0471, 1.0),
          "insulated_back_glass_polymer": (-2.81, -0.0455, 0.0), "open_rack_glass_polymer": (-3.56, -0.0750, 3.0)}
CHARGER_LIMITING = ["absorption", "float", "equalize", "external control", "ess", "storage"]
CHARGER_FREE = ["bulk", "off", "fault", "idle"]
#: Hour of the local day before, at which day-ahead forecasts count; days that
#: a score needs.
DAY_AHEAD_HOUR, SCORE_DAYS = 18, 3
#: Below this clear-sky mean an hour has no shape.
SHAPE_FLOOR = 1.0
#: Load that stands for the highest one seen in a stored curve.
MAX_LOAD_KEY = -1
#: Factors to m/s, hPa, W/m2, lx, mm and W, by quantity and lower-case symbol.
UNITS = {
    "speed": {"m/s": 1.0, "ms": 1.0, "km/h": 1 / 3.6, "kph": 1 / 3.6, "mph": 0.44704, "mi/h": 0.44704, "kn": 0.514444, "kt": 0.514444, "ft/s": 0.3048},
    "pressure": {"hpa": 1.0, "mbar": 1.0, "bar": 1000.0, "pa": 0.01, "kpa": 10.0, "inhg": 33.8639, "mmhg": 1.33322, "psi": 68.9476},
    "irradiance": {"w/m²": 1.0, "w/m2": 1.0, "kw/m²": 1000.0, "kw/m2": 1000.0},
    "illuminance": {"lx": 1.0, "lux": 1.0, "klx": 1000.0},
    "precipitation": {"mm": 1.0, "mm/h": 1.0, "cm": 10.0, "in": 25.4, "in/h": 25.4},
    "power": {"w": 1.0, "kw": 1000.0, "mw": 1_000_000.0, "va": 1.0, "kva": 1000.0},
    "ratio": {"%": 1.0},
}
#: Fixed values of the Perez et al. (1990) sky: upper ends of the clearness
#: bins, and of each bin F11, F12, F13, F21, F22, F23 (all sites composite).
PEREZ_BINS = [1.065, 1.23, 1.5, 1.95, 2.8, 4.5, 6.2]
PEREZ = [(-0.008, 0.588, -0.062, -0.060, 0.072, -0.022), (0.130, 0.683, -0.151, -0.019, 0.066, -0.029), (0.330, 0.487, -0.221, 0.055, -0.064, -0.026),
         (0.568, 0.187, -0.295, 0.109, -0.152, -0.014), (0.873, -0.392, -0.362, 0.226, -0.462, 0.001), (1.132, -1.237, -0.412, 0.288, -0.823, 0.056),
         (1.060, -1.600, -0.359, 0.264, -1.127, 0.131), (0.678, -0.327, -0.250, 0.156, -1.377, 0.251)]
PEREZ_KAPPA = 1.041

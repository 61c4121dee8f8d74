"""Irradiance to power as native column expressions (PHY-01..13 and 15), from the
published models: Spencer, Kasten-Young, Ineichen-Perez, Erbs, Hay-Davies,
ASHRAE, SAPM, PVWatts. Each builder returns SQL text of columns, so a plan of
them stays inside one code-generated stage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C


def day_angle(ts: str) -> str:
    return f"(2 * pi() * (({ts} / 86400.0) % 365.2425) / 365.2425)"


def declination(ts: str) -> str:
    """Spencer 1971, in radians."""
    b = day_angle(ts)
    return (f"(0.006918 - 0.399912 * cos({b}) + 0.070257 * sin({b}) - 0.006758 * cos(2 * {b}) + 0.000907 * sin(2 * {b})"
            f" - 0.002697 * cos(3 * {b}) + 0.00148 * sin(3 * {b}))")


def equation_of_time(ts: str) -> str:
    """Minutes (Spencer 1971)."""
    b = day_angle(ts)
    return f"(229.18 * (0.000075 + 0.001868 * cos({b}) - 0.032077 * sin({b}) - 0.014615 * cos(2 * {b}) - 0.040849 * sin(2 * {b})))"


#: Steps in order; each may use the columns before it. Inputs: ts (interval
#: midpoint, epoch seconds), lat, lon, altitude, turbidity, ghi, dni, dhi,
#: temp_c, wind_ms, tilt, azimuth, kwp, temp_coeff, system_eff, shade (factor
#: of direct light), and mount_a, mount_b, mount_dt.
SUN = [
    # The angle's multiples from one sine and one cosine.
    ("day_angle", day_angle("ts")),
    ("sin_b", "sin(day_angle)"),
    ("cos_b", "cos(day_angle)"),
    ("sin_2b", "2 * sin_b * cos_b"),
    ("cos_2b", "cos_b * cos_b - sin_b * sin_b"),
    ("decl", "0.006918 - 0.399912 * cos_b + 0.070257 * sin_b - 0.006758 * cos_2b + 0.000907 * sin_2b - 0.002697 * (cos_2b * cos_b - sin_2b * sin_b) + 0.00148 * (sin_2b * cos_b + cos_2b * sin_b)"),
    ("eot_min", "229.18 * (0.000075 + 0.001868 * cos_b - 0.032077 * sin_b - 0.014615 * cos_2b - 0.040849 * sin_2b)"),
    ("hour_angle", "radians(((ts % 86400) / 240.0 + lon + eot_min / 4.0) - 180.0)"),
    ("cos_z", "sin(radians(lat)) * sin(decl) + cos(radians(lat)) * cos(decl) * cos(hour_angle)"),
    ("elevation", "degrees(asin(greatest(-1.0, least(1.0, cos_z))))"),
    ("sun_azimuth", "degrees(atan2(-sin(hour_angle), tan(decl) * cos(radians(lat)) - sin(radians(lat)) * cos(hour_angle)))"),
    ("sun_az", "case when sun_azimuth < 0 then sun_azimuth + 360 else sun_azimuth end"),
    ("e0", "1366.1 * (1.00011 + 0.034221 * cos_b + 0.00128 * sin_b + 0.000719 * cos_2b + 0.000077 * sin_2b)"),
]
CLEARSKY = [
    ("cz", "greatest(cos_z, 0.0)"),
    ("airmass", "case when elevation > 0 then exp(-altitude / 8434.5) / (cz + 0.50572 * pow(elevation + 6.07995, -1.6364)) else null end"),
    ("fh1", "exp(-altitude / 8000.0)"),
    ("fh2", "exp(-altitude / 1250.0)"),
    ("cs_ghi", "coalesce((5.09e-5 * altitude + 0.868) * e0 * cz * exp(-(3.92e-5 * altitude + 0.0387) * airmass * (fh1 + fh2 * (turbidity - 1))), 0.0)"),
    ("cs_beam", "coalesce(e0 * (0.664 + 0.163 / fh1) * exp(-0.09 * airmass * (turbidity - 1)), 0.0)"),
    ("cs_dni", "case when cz > 0.01 then least(cs_beam, cs_ghi * (1 - (0.1 - 0.2 * exp(-turbidity)) / (0.1 + 0.882 / fh1)) / cz) else 0.0 end"),
    ("cs_dhi", "greatest(cs_ghi - cs_dni * cz, 0.0)"),
]
COMPONENTS = [
    ("plausible", "case when dni is null or dhi is null or ghi is null then false when ghi <= 20 or elevation < 5 then true else abs(dhi + dni * cz - ghi) / ghi <= 0.15 end"),
    ("kt", "greatest(least(ghi / (e0 * greatest(cz, 0.065)), 2.0), 0.0)"),
    ("diffuse_share", "case when kt <= 0.22 then 1 - 0.09 * kt when kt <= 0.8 then 0.9511 - 0.1604 * kt + 4.388 * kt * kt - 16.638 * kt * kt * kt + 12.336 * kt * kt * kt * kt else 0.165 end"),
    ("dhi_used", "case when plausible then dhi when elevation < 3 then ghi else ghi * diffuse_share end"),
    ("dni_used", "case when plausible then dni when elevation < 3 then 0.0 else greatest(ghi - dhi_used, 0.0) / cz end"),
]
PLANE = [
    ("cos_aoi", "cz * cos(radians(tilt)) + sin(radians(tilt)) * sqrt(greatest(1 - cz * cz, 0.0)) * cos(radians(sun_az - azimuth))"),
    ("incidence", "greatest(cos_aoi, 0.0)"),
    ("iam", "case when cos_aoi <= 0 then 0.0 else greatest(1 - 0.05 * (1 / cos_aoi - 1), 0.0) end"),
    ("anisotropy", "dni_used / e0"),
    ("poa_direct", "greatest(dni_used * incidence * iam, 0.0)"),
    ("poa_sky", "dhi_used * (anisotropy * incidence / greatest(cz, 0.01745) + (1 - anisotropy) * (1 + cos(radians(tilt))) / 2)"),
    ("poa_ground", f"ghi * {C.ALBEDO} * (1 - cos(radians(tilt))) / 2"),
    ("poa_diffuse", "greatest(poa_sky + poa_ground, 0.0)"),
    ("poa", "poa_direct + poa_diffuse"),
    ("beam_share", "case when poa > 0 then poa_direct / poa else 0.0 end"),
    ("poa_effective", "poa_direct * shade + poa_diffuse"),
]
POWER = [
    ("cell_c", "poa * exp(mount_a + mount_b * wind_ms) + temp_c + poa / 1000 * mount_dt"),
    ("power_w", "coalesce(greatest(least(poa_effective / 1000 * kwp * 1000 * (1 + temp_coeff * (cell_c - 25)) * system_eff, kwp * 1000), 0.0), 0.0)"),
]
#: Ceiling of what any sky could give on a plane (PHY-15).
CEILING = [
    ("beam_ceiling", f"ghi * incidence / greatest(cz, sin(radians({C.CEILING_ELEVATION})))"),
    ("sky_ceiling", "ghi * (1 + cos(radians(tilt))) / 2"),
    ("poa_ceiling", f"least(greatest(beam_ceiling, sky_ceiling) + ghi * {C.CEILING_ALBEDO} * (1 - cos(radians(tilt))) / 2, {C.CEILING_CAP})"),
]
CHAIN = SUN + CLEARSKY + COMPONENTS + PLANE + POWER + CEILING
#: Refraction lifts the sun (PHY-01; Bennett 1982), nothing below -1 degree.
APPARENT = [("apparent_elevation", "elevation + case when elevation > -1 then 1 / tan(radians(elevation + 7.31 / (elevation + 4.4))) / 60 else 0.0 end")]
#: Solar noon, sunrise and sunset of the UTC day of ``day`` (its first second)
#: as epoch seconds (PHY-04); NULL on polar days and nights. The sun rises with
#: its upper limb, refracted: 0.833 degrees below the horizon.
DAYLIGHT = [
    ("noon_guess", "day + 43200 - lon * 240"),
    ("noon_ts", f"noon_guess - {equation_of_time('noon_guess')} * 60"),
    ("noon_decl", declination("noon_guess")),
    ("cos_rise", "(sin(radians(-0.833)) - sin(radians(lat)) * sin(noon_decl)) / (cos(radians(lat)) * cos(noon_decl))"),
    ("half_day_s", "case when abs(cos_rise) < 1 then degrees(acos(greatest(-1.0, least(1.0, cos_rise)))) * 240 end"),
    ("sunrise_ts", "noon_ts - half_day_s"),
    ("sunset_ts", "noon_ts + half_day_s"),
]
def _by_bin(column: int) -> str:
    """A coefficient of the clearness bin of ``epsilon``."""
    cases = " ".join(f"when epsilon < {end} then {row[column]}" for end, row in zip(C.PEREZ_BINS, C.PEREZ))
    return f"case {cases} else {C.PEREZ[-1][column]} end"


#: Steps of the anisotropic sky of Perez et al. (1990), with ``components_ok``
#: (all components of the batch are plausible) besides the inputs.
PEREZ = [
    ("zenith", "acos(least(1.0, cz))"),
    ("epsilon", f"case when dhi_used > 0 then ((dhi_used + dni_used) / dhi_used + {C.PEREZ_KAPPA} * zenith * zenith * zenith) / (1 + {C.PEREZ_KAPPA} * zenith * zenith * zenith) end"),
    ("brightness", "dhi_used * coalesce(airmass * exp(altitude / 8434.5), 0.0) / e0"),
    ("circumsolar", f"greatest(0.0, ({_by_bin(0)}) + ({_by_bin(1)}) * brightness + ({_by_bin(2)}) * zenith)"),
    ("horizon", f"({_by_bin(3)}) + ({_by_bin(4)}) * brightness + ({_by_bin(5)}) * zenith"),
]
#: cos(85 degrees), below which the sun counts as that low.
LOW_SUN = 0.0871557427476582
SKIES = {
    "haydavies": dict(PLANE)["poa_sky"],
    "isotropic": "dhi_used * (1 + cos(radians(tilt))) / 2",
    "perez": f"case when not components_ok then {dict(PLANE)['poa_sky']} when dhi_used > 0 then greatest(0.0, dhi_used * ((1 - circumsolar) * (1 + cos(radians(tilt))) / 2 + circumsolar * incidence / greatest(cz, {LOW_SUN}) + horizon * sin(radians(tilt)))) else 0.0 end",
}


def plane(model: str = "haydavies", scope: str = "beam") -> list[tuple[str, str]]:
    """Steps of the tilted plane: the model of sky light, and whether ``shade``
    takes the direct light alone (beam) or all of it (total); the share of
    light that it left is ``shading_applied`` (PHY-08, PHY-10). The perez sky
    leans on the split of the light, so where ``components_ok`` says that some
    of its batch is not plausible it gives way to Hay-Davies."""
    if model not in SKIES:
        raise ValueError(f"no sky model {model!r}; there are {', '.join(sorted(SKIES))}")
    effective = {"beam": "poa_direct * shade + poa_diffuse", "total": "(poa_direct + poa_diffuse) * shade", "column": "case when beam_scope then poa_direct * shade + poa_diffuse else (poa_direct + poa_diffuse) * shade end"}[scope]
    steps = [(n, {"poa_sky": SKIES[model], "poa_effective": effective}.get(n, t)) for n, t in PLANE]
    return (PEREZ if model == "perez" else []) + steps + [("shading_applied", "case when poa > 0 then poa_effective / poa else 1.0 end")]


def run(df: DataFrame, steps=None) -> DataFrame:
    """``df`` with the columns of all steps (PHY-13), in one projection whose
    later columns refer to the ones before; columns of those names are
    replaced."""
    steps = steps or CHAIN
    base = df.drop(*[name for name, _ in steps])
    return base.select("*", *[F.expr(sql).alias(name) for name, sql in steps])


def turbidity(lat: str, day: str) -> str:
    """Climatological Linke turbidity (PHY-02)."""
    return f"(3.5 - 0.01 * abs({lat}) + 0.8 * cos(2 * pi() * ({day} - case when {lat} >= 0 then 200 else 17.5 end) / 365))"


def nested_sql(source: str, steps=None) -> str:
    """The same steps as nested ANSI selects over the relation ``source``."""
    sql = source
    for i, (name, text) in enumerate(steps or CHAIN):
        sql = f"SELECT *, {text} AS {name} FROM ({sql}) AS s{i}"
    return sql

"""Named variables and regions."""

from __future__ import annotations

from lattica.spec import Leadtime, Region, Variable

# Names under which archives publish the variables.
VARIABLES = {
    "t2m_juno": Variable("t2m", unit="K"),
    "msl_juno": Variable("msl", unit="Pa"),
    "u10_juno": Variable("u10", unit="m/s"),
    "v10_juno": Variable("v10", unit="m/s"),
    "d2m_juno": Variable("d2m", unit="K"),
    "tcc_juno": Variable("tcc", unit="[0-1]"),
    "gh850_juno": Variable("gh", unit="gpm", levhpa=850),
    "t2m_era5": Variable("2t", unit="K"),
    "mld00_1": Variable("mixed_layer_depth_0_01", unit="m"),
    "sss_cds_fc": Variable("sos", "sea_surface_salinity"),
    "sss_juno_fc": Variable("sos", levm=0),
    "sss_oras5_an": Variable("sosaline", "sea_surface_salinity"),
    "sss_juno_an": Variable("sss_m", levm=0),
    "t14d_juno_fc": Variable("t14d"),
    "t14d_oras5_an": Variable("so14chgt", "depth_of_14_c_isotherm", "m"),
    "t17d_juno_fc": Variable("t17d"),
    "t17d_oras5_an": Variable("so17chgt", "depth_of_17_c_isotherm", "m"),
    "t20d_juno_fc": Variable("t20d"),
    "t20d_oras5_an": Variable("so20chgt", "depth_of_20_c_isotherm", "m"),
    "ssh_cds_fc": Variable("ssh", "sea_surface_height_above_geoid", "m"),
    "ssh_oras5_an": Variable("sossheig", "sea_surface_height", "m"),
}
# Regions by west, east and north, south.
REGIONS = {
    "north_atl": Region("NorthAtlantic", (-80, -20), (60, 20)),
    "conus": Region("ConUS", (-130, -90), (45, 30)),
    "europe": Region("Europe", (-10, 36), (55, 35)),
    "italy": Region("ItalianPeninsula", (5, 23.5), (49, 25.5)),
    "pacific": Region("CentralPacific", (-200, -120), (30, -30)),
}
#: Forecast variables whose files hold several lead times.
WITH_LEADTIME = {"sss_cds_fc", "sss_juno_fc", "t14d_juno_fc", "t17d_juno_fc", "t20d_juno_fc", "ssh_cds_fc"}


def variable(key: str, leadtime: Leadtime | None = None) -> Variable:
    from dataclasses import replace

    found = VARIABLES[key]
    return replace(found, leadtime=leadtime) if leadtime and key in WITH_LEADTIME else found

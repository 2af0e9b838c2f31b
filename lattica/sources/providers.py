"""Reader options for known archives, by name. root_path: where a site keeps the archive's files."""

from __future__ import annotations

from lattica.registry import PROVIDERS
from lattica.spec import ProviderSpec


def _spec(source: str, base: dict, overrides: dict | None, more: dict) -> ProviderSpec:
    return ProviderSpec(source, base | (overrides or {}) | more)


def build(name: str, **params) -> ProviderSpec:
    return PROVIDERS[name](**params)


def require(params: dict, *keys: str) -> None:
    if lacking := [k for k in keys if k not in params]:
        raise KeyError(f"missing: {', '.join(lacking)}")


# Names, paths and formats of the archives.
def _hourly_files(header: str, directory: str, lead: dict) -> dict:
    return {"file_header": header, "file_suffix": "*", "file_path_date_format": directory, "file_date_format": "MMddHHmm", "both_dates": True, "minus_hours": 1, "plus_hours": 1, "concat_dim": "valid_time", "engine": "cfgrib", "lead_time": lead}


@PROVIDERS.register("atmo.juno.ecmwf.forecast.hourly")
def forecast_hourly(leadtime_value: int, leadtime_unit: str, root_path: str, overrides: dict | None = None, **more) -> ProviderSpec:
    return _spec("files", {"root_path": root_path, **_hourly_files("JLS", "yyyyMMdd", {leadtime_unit: leadtime_value})}, overrides, more)


@PROVIDERS.register("atmo.juno.ecmwf.analysis.6hourly")
def analysis_6hourly(root_path: str, overrides: dict | None = None, **more) -> ProviderSpec:
    return _spec("files", {"root_path": root_path, **_hourly_files("JLD", "yyyy/MM", {"hours": 0})}, overrides, more)


@PROVIDERS.register("atmo.earthkit.era5.reanalysis.6hourly")
def era5(product_type: str = "reanalysis", overrides: dict | None = None, **more) -> ProviderSpec:
    return _spec("remote", {"provider": "cds", "dataset": "reanalysis-era5-single-levels", "split_request": True, "product_type": product_type, "lead_time": {"hours": 0}}, overrides, more)


@PROVIDERS.register("ocean.juno.cmcc.hindcast.monthly")
def ocean_hindcast(var_name: str, leadtime_value: int, leadtime_unit: str, root_path: str, realizations: str | int = "all", overrides: dict | None = None, **more) -> ProviderSpec:
    members = str(realizations) if isinstance(realizations, int) else "*"
    base = {"root_path": root_path, "engine": "h5netcdf", "file_path_date_format": "yyyyMM", "file_header": "cmcc_CMCC-CM3-v20231101_hindcast_S", "file_suffix": f"*ocean_mon_ocean2d_{var_name}_r{members}i00p00.nc", "file_date_format": "yyyyMMdd", "both_dates": False}
    return _spec("files", {**base, "realizations": realizations, "lead_time": {leadtime_unit: leadtime_value}, "regrid_resolution": 0.25, "concat_dim": "time"}, overrides, more)


@PROVIDERS.register("ocean.earthkit.cmcc.hindcast.monthly")
def ocean_hindcast_remote(var_name: str, leadtime_value: int, leadtime_unit: str, system: str = "4", split_month: int = 1, split_month_jump: tuple[str, ...] = ("03", "04", "06", "07"), overrides: dict | None = None, **more) -> ProviderSpec:
    base = {"provider": "cds", "dataset": "seasonal-monthly-ocean", "variable": var_name, "regrid_resolution": 0.25, "split_request": True, "split_month": split_month, "split_month_jump": split_month_jump, "request_type": "monthly"}
    return _spec("remote", {**base, "forecast_type": "hindcast", "originating_centre": "cmcc", "system": system, "lead_time": {leadtime_unit: leadtime_value}}, overrides, more)


@PROVIDERS.register("ocean.earthkit.oras5.reanalysis.monthly")
def oras5(var_name: str, product_type: str = "consolidated", select_area_after_request: bool = True, overrides: dict | None = None, **more) -> ProviderSpec:
    base = {"provider": "cds", "dataset": "reanalysis-oras5", "variable": var_name, "split_request": True, "request_type": "monthly", "product_type": product_type, "vertical_resolution": "single_level"}
    return _spec("remote", {**base, "select_area_after_request": select_area_after_request, "regrid_resolution": 0.25, "lead_time": {"hours": 0}}, overrides, more)


@PROVIDERS.register("earthkit.ecmwf_open_data.fc.sfc")
def open_data(param: str, levtype: str = "sfc", overrides: dict | None = None, **more) -> ProviderSpec:
    return _spec("remote", {"provider": "ecmwf-open-data", "split_request": True, "select_area_after_request": True, "param": param, "levtype": levtype}, overrides, more)

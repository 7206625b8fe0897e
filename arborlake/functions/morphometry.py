"""Published coronary morphometry (Kassab et al. 1993, Am J Physiol 265:H350) as parameter tables.

Other organs and species come in the same form: rows of ``schema.ORDER_PARAMS``
and ``schema.CONNECTIVITY`` read from files or built by the user.
"""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from arborlake import schema

# Fixed values, one row per order:
# (d_mean, d_sd, l_mean, l_sd, d_mean_elem, d_sd_elem, l_mean_elem, l_sd_elem, se_ratio, element_count), in um.
RCA_ORDERS = (
    (8.0, 1.0, 20.0, 10.0, 8.0, 1.0, 20.0, 10.0, 1.0, 0.0),
    (9.6, 0.97, 69.0, 46.0, 9.3, 0.84, 125.0, 84.0, 1.88, 393294.0),
    (13.2, 1.6, 83.0, 70.0, 12.8, 1.4, 141.0, 103.0, 1.88, 138050.0),
    (19.1, 2.7, 85.0, 61.0, 17.7, 2.1, 178.0, 105.0, 2.20, 51915.0),
    (34.1, 6.0, 118.0, 113.0, 28.6, 5.4, 253.0, 174.0, 2.30, 20074.0),
    (64.4, 15.1, 449.0, 350.0, 63.1, 11.3, 545.0, 415.0, 2.00, 7354.0),
    (137.0, 31.5, 748.0, 664.0, 132.0, 22.2, 1640.0, 1130.0, 2.30, 1458.0),
    (265.0, 45.2, 986.0, 810.0, 256.0, 30.1, 3130.0, 2110.0, 3.28, 403.0),
    (438.0, 64.7, 1260.0, 1100.0, 428.0, 47.5, 5390.0, 3830.0, 4.68, 114.0),
    (730.0, 129.0, 1820.0, 1310.0, 706.0, 75.2, 9060.0, 5560.0, 5.38, 35.0),
    (1430.0, 379.0, 1890.0, 1380.0, 1302.0, 239.0, 16100.0, 13300.0, 8.5, 10.0),
    (3218.0, 388.0, 3240.0, 2090.0, 3218.0, 388.0, 84240.0, 0.0, 26.0, 1.0),
)
# Fixed values, daughters per parent element: {parent order: {daughter order: rate}}.
RCA_RATES = {
    1: {0: 2.75, 1: 0.131},
    2: {0: 0.674, 1: 2.13, 2: 0.080},
    3: {0: 0.151, 1: 0.802, 2: 2.15, 3: 0.070},
    4: {0: 0.040, 1: 0.300, 2: 0.700, 3: 2.12, 4: 0.160},
    5: {1: 0.008, 2: 0.159, 3: 0.688, 4: 2.13, 5: 0.344},
    6: {1: 0.004, 2: 0.020, 3: 0.314, 4: 0.444, 5: 2.43, 6: 0.167},
    7: {2: 0.037, 3: 0.244, 4: 0.640, 5: 1.43, 6: 2.14, 7: 0.130},
    8: {3: 0.143, 4: 0.468, 5: 1.51, 6: 1.37, 7: 2.32, 8: 0.099},
    9: {3: 0.059, 4: 0.324, 5: 0.853, 6: 1.68, 7: 1.23, 8: 2.62, 9: 0.059},
    10: {5: 0.727, 6: 1.80, 7: 2.80, 8: 2.00, 9: 2.40, 10: 0.400},
    11: {6: 1.0, 7: 11.0, 8: 8.0, 9: 5.0, 10: 6.0},
}

# Fixed values, left anterior descending artery.
LAD_ORDERS = (
    (8.0, 1.0, 20.0, 10.0, 8.0, 1.0, 20.0, 10.0, 1.0, 0.0),
    (9.2, 0.94, 56.0, 38.0, 9.0, 0.73, 115.0, 66.0, 2.30, 368554.0),
    (13.0, 1.7, 72.0, 45.0, 12.3, 1.3, 136.0, 88.0, 1.79, 140293.0),
    (18.7, 2.6, 73.0, 49.0, 17.7, 2.2, 149.0, 104.0, 2.00, 44456.0),
    (34.6, 7.4, 112.0, 100.0, 30.5, 6.0, 353.0, 154.0, 2.28, 17985.0),
    (71.6, 17.2, 454.0, 330.0, 66.2, 13.6, 502.0, 349.0, 2.02, 6386.0),
    (150.0, 35.8, 609.0, 480.0, 139.0, 24.1, 1310.0, 914.0, 2.23, 1385.0),
    (303.0, 54.5, 920.0, 790.0, 308.0, 56.6, 3540.0, 2110.0, 3.89, 348.0),
    (467.0, 56.1, 1090.0, 830.0, 462.0, 40.9, 4990.0, 3020.0, 4.69, 113.0),
    (715.0, 130.0, 1540.0, 1250.0, 714.0, 81.8, 9030.0, 6130.0, 6.06, 37.0),
    (1492.0, 365.0, 2260.0, 1560.0, 1573.0, 361.0, 20300.0, 17900.0, 9.0, 7.0),
    (3176.0, 654.0, 2820.0, 1960.0, 3176.0, 654.0, 47940.0, 0.0, 17.0, 1.0),
)
LAD_RATES = {
    1: {0: 3.18, 1: 0.144},
    2: {0: 0.675, 1: 2.04, 2: 0.094},
    3: {0: 0.148, 1: 0.630, 2: 2.24, 3: 0.074},
    4: {1: 0.071, 2: 1.50, 3: 2.14, 4: 0.143},
    5: {2: 0.063, 3: 0.381, 4: 2.25, 5: 0.238},
    6: {2: 0.094, 3: 0.098, 4: 0.425, 5: 2.50, 6: 0.155},
    7: {2: 0.023, 3: 0.120, 4: 0.380, 5: 1.91, 6: 2.50, 7: 0.116},
    8: {3: 0.092, 4: 0.428, 5: 1.58, 6: 1.58, 7: 2.09, 8: 0.061},
    9: {3: 0.030, 4: 0.303, 5: 1.38, 6: 1.48, 7: 1.30, 8: 2.50, 9: 0.121},
    10: {4: 0.167, 5: 0.667, 6: 1.17, 7: 2.00, 8: 2.50, 9: 3.33, 10: 0.100},
    11: {7: 2.0, 8: 3.0, 9: 8.0, 10: 5.0},
}

# Fixed values, left circumflex artery.
LCX_ORDERS = (
    (8.0, 1.0, 20.0, 10.0, 8.0, 1.0, 20.0, 10.0, 1.0, 0.0),
    (9.2, 0.94, 56.0, 38.0, 9.0, 0.73, 115.0, 66.0, 2.30, 149380.0),
    (13.0, 1.7, 72.0, 45.0, 12.3, 1.3, 136.0, 88.0, 1.79, 56915.0),
    (18.7, 2.6, 72.0, 49.0, 17.7, 2.2, 149.0, 104.0, 2.00, 17820.0),
    (33.2, 9.1, 190.0, 97.0, 27.5, 6.1, 405.0, 170.0, 2.06, 7554.0),
    (76.3, 14.5, 615.0, 508.0, 73.9, 14.2, 908.0, 763.0, 2.20, 2148.0),
    (143.0, 30.5, 1110.0, 983.0, 139.0, 26.2, 1830.0, 1340.0, 2.11, 638.0),
    (285.0, 53.3, 1600.0, 1330.0, 279.0, 38.4, 4220.0, 2260.0, 2.75, 144.0),
    (468.0, 78.8, 1780.0, 1460.0, 462.0, 56.1, 6980.0, 3920.0, 4.22, 51.0),
    (1025.0, 273.0, 3180.0, 2410.0, 961.0, 193.0, 21000.0, 15600.0, 6.60, 10.0),
    (2603.0, 337.0, 3540.0, 2000.0, 2603.0, 337.0, 49560.0, 0.0, 14.0, 1.0),
)
LCX_RATES = {
    1: {0: 3.18, 1: 0.144},
    2: {0: 0.675, 1: 2.04, 2: 0.094},
    3: {0: 0.148, 1: 0.630, 2: 2.24, 3: 0.074},
    4: {1: 0.071, 2: 1.50, 3: 2.14, 4: 0.143},
    5: {2: 0.150, 3: 0.150, 4: 2.85, 5: 0.100},
    6: {3: 0.025, 4: 0.385, 5: 2.51, 6: 0.213},
    7: {3: 0.011, 4: 0.179, 5: 1.13, 6: 2.33, 7: 0.168},
    8: {4: 0.109, 5: 0.956, 6: 2.02, 7: 2.04, 8: 0.196},
    9: {5: 0.444, 6: 1.78, 7: 2.00, 8: 4.00, 9: 0.111},
    10: {6: 2.0, 7: 4.0, 8: 4.0, 9: 8.0},
}

# Fixed values.
SCALARS = {
    "gamma": 7 / 3, "viscosity": 0.0035, "root_pa": 13332.0, "terminal_pa": 3999.6,
    "cutoff_um": 8.0, "chi_th": 0.83, "rho_th": 0.83, "alpha": 2.5, "beta": 0.8,
}
PRESETS = {"RCA": (RCA_ORDERS, RCA_RATES), "LAD": (LAD_ORDERS, LAD_RATES), "LCX": (LCX_ORDERS, LCX_RATES)}


def lower_bounds(orders) -> list[float]:
    """Bound between neighbours: middle of (mean + sd) below and (mean - sd) above (Jiang 1994)."""
    return [0.0] + [((a[0] + a[1]) + (b[0] - b[1])) / 2 for a, b in zip(orders, orders[1:])]


def order_params(spark: SparkSession, presets=None) -> DataFrame:
    rows = []
    for artery, (orders, _) in (presets or PRESETS).items():
        bounds = lower_bounds(orders)
        rows += [(artery, i, *orders[i], bounds[i]) for i in range(len(orders))]
    return spark.createDataFrame(rows, schema.ORDER_PARAMS)


def connectivity(spark: SparkSession, presets=None) -> DataFrame:
    rows = [
        (artery, child, parent, rate)
        for artery, (_, rates) in (presets or PRESETS).items()
        for parent, column in rates.items()
        for child, rate in column.items()
    ]
    return spark.createDataFrame(rows, schema.CONNECTIVITY)


def scalars(spark: SparkSession, presets=None, **override) -> DataFrame:
    """One row per artery; keyword arguments replace single values."""
    unknown = set(override) - set(SCALARS)
    if unknown:
        raise ValueError(f"unknown parameters: {sorted(unknown)}")
    values = {**SCALARS, **override}
    rows = [
        (artery, len(orders), *[float(values[k]) for k in (
            "gamma", "viscosity", "root_pa", "terminal_pa", "cutoff_um", "chi_th", "rho_th", "alpha", "beta")])
        for artery, (orders, _) in (presets or PRESETS).items()
    ]
    return spark.createDataFrame(rows, schema.SCALARS)


def with_values(params: DataFrame, **changed) -> DataFrame:
    """Parameter table with some columns replaced, e.g. pressures or viscosity."""
    missing = set(changed) - set(params.columns)
    if missing:
        raise ValueError(f"no such parameter: {sorted(missing)}")
    return params.withColumns({k: F.lit(v).cast(params.schema[k].dataType) for k, v in changed.items()})


def artery_of(tree: Column, default: str = "RCA", override: dict[str, str] | None = None) -> Column:
    """Preset of a tree: an explicit override, else the first of RCA, LAD, LCX in its name, else the default."""
    upper = F.upper(tree)
    by_name = F.lit(default)
    for artery in ("LCX", "LAD", "RCA"):
        by_name = F.when(upper.contains(artery), F.lit(artery)).otherwise(by_name)
    if not override:
        return by_name
    table = F.create_map(*[F.lit(v) for pair in override.items() for v in pair])
    return F.coalesce(F.try_element_at(table, tree), by_name)

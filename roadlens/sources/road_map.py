"""Road map of the eastbound road: piecewise fits of grade and elevation over miles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# ---- fixed values: interval number, start and end in miles, then the fit ----
# grade in degrees = slope x + intercept
GRADE_FIT = [
    (1, 0.000000, 0.206254, 0.988805, 0.003773),
    (2, 0.206254, 0.340589, 22.654981, -4.464967),
    (3, 0.340589, 0.649388, -18.794861, 9.652402),
    (4, 0.649388, 0.809214, 34.385286, -24.882170),
    (5, 0.809214, 1.454865, 0.000000, 2.942898),
    (6, 1.454865, 1.547785, -19.708174, 31.615874),
    (7, 1.547785, 2.774125, 0.000000, 1.111856),
    (8, 2.774125, 2.972806, -20.887327, 59.056113),
    (9, 2.972806, 3.257819, -0.000000, -3.037854),
    (10, 3.257819, 3.362365, 20.951517, -71.294345),
    (11, 3.362365, 3.471720, -7.315468, 23.749571),
    (12, 3.471720, 3.566863, 13.935633, -50.028302),
    (13, 3.566863, 3.685271, -5.955258, 20.919786),
    (14, 3.685271, 3.833847, 4.223134, -16.590342),
    (15, 3.833847, 4.640455, 0.000000, -0.399496),
    (16, 4.640455, 4.735119, 8.530739, -39.985771),
    (17, 4.735119, 4.901505, -6.827316, 32.736436),
    (18, 4.901505, 5.057002, 10.066122, -50.066831),
    (19, 5.057002, 5.279020, -9.663600, 49.706411),
    (20, 5.279020, 5.536074, 9.305238, -50.430455),
    (21, 5.536074, 5.698455, 0.000000, 1.084031),
    (22, 5.698455, 5.844915, 4.773366, -26.116579),
    (23, 5.844915, 6.033959, -0.000000, 1.783338),
    (24, 6.033959, 6.258860, -5.587792, 35.499829),
    (25, 6.258860, 6.386708, 8.486086, -52.586605),
    (26, 6.386708, 6.710080, -0.000000, 1.611545),
    (27, 6.710080, 6.983640, -15.147307, 103.250957),
    (28, 6.983640, 7.262262, -0.000000, -2.532386),
    (29, 7.262262, 7.596232, 5.718114, -44.059068),
    (30, 7.596232, 7.763073, -0.000000, -0.622947),
    (31, 7.763073, 7.857831, 12.450588, -97.278012),
]
# elevation in feet = quadratic x^2 + linear x + intercept
ELEVATION_FIT = [
    (1, 0.000000, 0.206254, 26.104452, 0.199214, 512.072935),
    (2, 0.206254, 0.340589, 598.091498, -235.750258, 536.405721),
    (3, 0.340589, 0.649388, -496.184330, 509.646826, 409.468619),
    (4, 0.649388, 0.809214, 907.771550, -1313.778576, 1001.524295),
    (5, 0.809214, 1.454865, 0.000000, 155.385014, 407.090141),
    (6, 1.454865, 1.547785, -520.295794, 1669.318147, -694.203372),
    (7, 1.547785, 2.774125, 0.000000, 58.705997, 552.237369),
    (8, 2.774125, 2.972806, -551.425433, 3118.162766, -3691.435106),
    (9, 2.972806, 3.257819, -0.000000, -160.398691, 1181.828164),
    (10, 3.257819, 3.362365, 553.120049, -3764.341416, 7052.345420),
    (11, 3.362365, 3.471720, -193.128355, 1253.977349, -1384.363822),
    (12, 3.471720, 3.566863, 367.900711, -2641.494346, 5377.629732),
    (13, 3.566863, 3.685271, -157.218811, 1104.564701, -1303.210429),
    (14, 3.685271, 3.833847, 111.490738, -875.970058, 2346.192752),
    (15, 3.833847, 4.640455, 0.000000, -21.093389, 707.459942),
    (16, 4.640455, 4.735119, 225.211510, -2111.248709, 5557.066951),
    (17, 4.735119, 4.901505, -180.241142, 1728.483821, -3533.726898),
    (18, 4.901505, 5.057002, 265.745621, -2643.528677, 7180.993166),
    (19, 5.057002, 5.279020, -255.119040, 2624.498501, -6139.218605),
    (20, 5.279020, 5.536074, 245.658283, -2662.728024, 7816.467400),
    (21, 5.536074, 5.698455, 0.000000, 57.236837, 287.504049),
    (22, 5.698455, 5.844915, 126.016862, -1378.955371, 4379.512093),
    (23, 5.844915, 6.033959, -0.000000, 94.160246, 74.394545),
    (24, 6.033959, 6.258860, -147.517709, 1874.390971, -5296.522377),
    (25, 6.258860, 6.386708, 224.032670, -2776.572744, 9258.343323),
    (26, 6.386708, 6.710080, -0.000000, 85.089576, 120.043071),
    (27, 6.710080, 6.983640, -399.888905, 5451.650530, -17884.942891),
    (28, 6.983640, 7.262262, -0.000000, -133.709981, 1618.131374),
    (29, 7.262262, 7.596232, 150.958210, -2326.318790, 9579.827204),
    (30, 7.596232, 7.763073, -0.000000, -32.891602, 869.124613),
    (31, 7.763073, 7.857831, 328.695523, -5136.279034, 20678.158690),
]
# -----------------------------------------------------------------------------


def grade_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(GRADE_FIT, "interval_number int, interval_start double, interval_end double, slope double, intercept double")


def elevation_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        ELEVATION_FIT, "interval_number int, interval_start double, interval_end double, quadratic_term double, linear_term double, intercept double")

"""Published aggregates used as fixed test values."""

# language, YES, NO, NA
SATISFACTION = [
    ("Ukrainian", 231, 109, 61),
    ("Swedish", 136, 49, 26),
    ("Spanish", 4996, 1339, 835),
    ("Slovenian", 7, 7, 2),
    ("Slovak", 46, 13, 20),
    ("Romanian", 73, 22, 14),
    ("Portuguese", 8017, 2275, 943),
    ("Polish", 500, 197, 87),
    ("Norwegian", 54, 18, 3),
    ("Maltese", 4, 5, 0),
    ("Lithuanian", 1, 0, 0),
    ("Latvian", 12, 11, 0),
    ("Italian", 3789, 1254, 248),
    ("Irish", 2, 3, 0),
    ("Hungarian", 60, 39, 8),
    ("Greek", 108, 86, 48),
    ("German", 3319, 1115, 718),
    ("Galician", 90, 36, 10),
    ("French", 3384, 972, 575),
    ("Finnish", 33, 14, 8),
    ("Estonian", 12, 1, 1),
    ("English", 121763, 37931, 34438),
    ("Dutch", 188, 51, 78),
    ("Danish", 99, 39, 34),
    ("Czech", 95, 41, 13),
    ("Croatian", 32, 11, 5),
    ("Catalan", 81, 15, 21),
    ("Bulgarian", 26, 16, 18),
]

# language, conversations
CONVERSATIONS = [
    ("English", 693617),
    ("Portuguese", 24576),
    ("Spanish", 16897),
    ("French", 13196),
    ("German", 12940),
    ("Italian", 11513),
    ("Polish", 2259),
    ("Ukrainian", 907),
    ("Dutch", 888),
    ("Greek", 765),
    ("Danish", 548),
    ("Swedish", 491),
    ("Czech", 426),
    ("Hungarian", 416),
    ("Romanian", 313),
    ("Galician", 283),
    ("Catalan", 278),
    ("Norwegian", 212),
    ("Bulgarian", 209),
    ("Slovak", 207),
    ("Finnish", 147),
    ("Croatian", 92),
    ("Slovenian", 69),
    ("Latvian", 42),
    ("Estonian", 39),
    ("Maltese", 16),
    ("Irish", 16),
    ("Lithuanian", 14),
]

KRUSKAL_DF = 27
# H statistic, p-value
KRUSKAL = [
    (3091.854983724905, 0.0),
    (163.3750468852174, 1.8340202569940384e-21),
    (8424.232136884057, 0.0),
    (314.1774623182697, 1.0756347583882144e-50),
    (811.5813465989087, 1.4175725073723547e-153),
    (30.178167374713723, 0.3062080599333263),
    (144.13788178286057, 5.899752606047607e-18),
    (717.7484892556968, 7.275996234538663e-134),
    (730.9406334325948, 1.2469423306152013e-136),
    (1774.8266058166437, 0.0),
    (665.9871373155358, 4.9728911474390705e-123),
    (3510.983111619778, 0.0),
    (2307.0424978453893, 0.0),
]

# language, mean user words
USER_WORDS = [
    ("Bulgarian", 92.6842105263158),
    ("Catalan", 97.99640287769785),
    ("Croatian", 103.06521739130434),
    ("Czech", 45.889671361502344),
    ("Danish", 83.93795620437956),
    ("Dutch", 88.875),
    ("English", 89.28374881238493),
    ("Estonian", 44.256410256410255),
    ("Finnish", 57.17687074829932),
    ("French", 92.67838739011822),
    ("Galician", 44.83745583038869),
    ("German", 87.44119010819165),
    ("Greek", 49.90065359477124),
    ("Hungarian", 46.03365384615385),
    ("Irish", 33.6875),
    ("Italian", 66.66012333883437),
    ("Latvian", 61.04761904761905),
    ("Lithuanian", 7.142857142857143),
    ("Maltese", 16.75),
    ("Norwegian", 50.99528301886792),
    ("Polish", 59.39884904825144),
    ("Portuguese", 83.19266764322917),
    ("Romanian", 76.28753993610223),
    ("Slovak", 67.23188405797102),
    ("Slovenian", 60.65217391304348),
    ("Spanish", 92.25306267384742),
    ("Swedish", 100.36863543788188),
    ("Ukrainian", 109.18522601984564),
]

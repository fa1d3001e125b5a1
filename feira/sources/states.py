"""State dimension: coordinates and names of the 27 Brazilian federative units."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values (must equal the reference's lookup tables): state code,
# centroid latitude, centroid longitude, state name.
STATES = [
    ("AC", -9.0238, -70.8120, "Acre"),
    ("AL", -9.5713, -36.7819, "Alagoas"),
    ("AP", 0.9020, -51.8544, "Amapá"),
    ("AM", -3.4168, -65.8561, "Amazonas"),
    ("BA", -12.5797, -41.7007, "Bahia"),
    ("CE", -5.4984, -39.3206, "Ceará"),
    ("DF", -15.7801, -47.9292, "Distrito Federal"),
    ("ES", -19.1834, -40.3089, "Espírito Santo"),
    ("GO", -15.8270, -49.8362, "Goiás"),
    ("MA", -5.4026, -45.1116, "Maranhão"),
    ("MT", -12.6819, -56.9211, "Mato Grosso"),
    ("MS", -20.7722, -54.7852, "Mato Grosso do Sul"),
    ("MG", -18.5122, -44.5550, "Minas Gerais"),
    ("PA", -3.4168, -52.0030, "Pará"),
    ("PB", -7.2400, -36.7820, "Paraíba"),
    ("PR", -24.7953, -51.7955, "Paraná"),
    ("PE", -8.8137, -36.9541, "Pernambuco"),
    ("PI", -6.6000, -42.2800, "Piauí"),
    ("RJ", -22.9068, -43.1729, "Rio de Janeiro"),
    ("RN", -5.7945, -36.5172, "Rio Grande do Norte"),
    ("RS", -30.0346, -51.2177, "Rio Grande do Sul"),
    ("RO", -11.5057, -63.5806, "Rondônia"),
    ("RR", 2.7376, -62.0751, "Roraima"),
    ("SC", -27.5954, -48.5480, "Santa Catarina"),
    ("SP", -23.5505, -46.6333, "São Paulo"),
    ("SE", -10.5741, -37.3857, "Sergipe"),
    ("TO", -10.1753, -48.2982, "Tocantins"),
]

STATES_DDL = "state string, lat double, lon double, state_name string"


def states_df(spark: SparkSession) -> DataFrame:
    """27-row dimension; its size is fixed, so it is always safe to broadcast."""
    return F.broadcast(spark.createDataFrame(STATES, STATES_DDL))

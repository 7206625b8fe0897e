"""Declared schemas. Nothing in the library infers a schema from files."""

from pyspark.sql import types as T


def _fields(spec):
    kinds = {"s": T.StringType(), "i": T.IntegerType(), "l": T.LongType(), "d": T.DoubleType(), "b": T.BooleanType()}
    out = T.StructType()
    for part in spec.split():
        name, kind = part.split(":")
        out = out.add(name, kinds[kind])
    return out


SEGMENT = _fields(
    "tree:s id:l parent_id:l child_slot:i px:d py:d pz:d dx:d dy:d dz:d "
    "radius_mm:d length_mm:d flow_m3_s:d p_prox_pa:d p_dist_pa:d resistance:d "
    "strahler_order:i generation:i is_terminal:b junction_type:s"
)
ORDER_PARAMS = _fields(
    "artery:s ord:i d_mean:d d_sd:d l_mean:d l_sd:d d_mean_elem:d d_sd_elem:d "
    "l_mean_elem:d l_sd_elem:d se_ratio:d element_count:d lower_bound_um:d"
)
CONNECTIVITY = _fields("artery:s child_order:i parent_order:i rate:d")
SCALARS = _fields(
    "artery:s n_orders:i gamma:d viscosity:d root_pa:d terminal_pa:d cutoff_um:d "
    "chi_th:d rho_th:d alpha:d beta:d"
)
LINE_POINT = _fields("line:s pos:i x:d y:d z:d radius_mm:d")
XYZ = _fields("x:d y:d z:d")
XYZR = _fields("x:d y:d z:d radius_mm:d")
SURFACE_POINT = _fields("surface:s id:l x:d y:d z:d nx:d ny:d nz:d")
LABEL = _fields("i:i j:i k:i label:i")
SURFACE = _fields("surface:s m:i n:i")
KNOT = _fields("surface:s dir:s idx:i value:d")
CONTROL_POINT = _fields("surface:s row:i col:i x:d y:d z:d")

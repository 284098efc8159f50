from limnos.functions.exprs import *  # noqa: F401,F403
from limnos.functions.constants import *  # noqa: F401,F403

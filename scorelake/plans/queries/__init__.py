from scorelake.plans.queries import texts  # noqa: F401
from scorelake.plans.queries import boards  # noqa: F401
from scorelake.plans.queries import structured  # noqa: F401
from scorelake.plans.queries import ingest  # noqa: F401
from scorelake.plans.queries import end_to_end  # noqa: F401
from scorelake.plans.queries import trees  # noqa: F401

"""Fields of the sales fact and of the datasets that feed it."""

# Dimensions of the fact, in the order reports list them.
REPORT_DIMENSIONS = (
    "seller_name", "sales_force", "family", "brand", "business_unit", "channel", "route_description",
)
CUBE_DIMENSIONS = (
    "family", "line", "brand", "business_unit", "supplier",
    "sales_scheme_name", "seller_name", "sales_force", "route_description", "channel",
)
CUBE_METRICS = ("quantity", "amount_net", "amount_final", "amount_net_internal")
FILTER_FIELDS = (
    "year", "month", "family", "line", "brand", "business_unit", "supplier", "product_name",
    "sales_scheme_name", "sales_force", "route_description", "seller_name", "channel",
)

# Fields each dataset accepts and the ones it requires.
DATASET_FIELDS = {
    "sales": (
        "date", "year", "month", "client_key", "client_name", "route_description", "seller_key",
        "seller_name", "sales_scheme_key", "sales_scheme_name", "product_key", "product_name",
        "invoice", "channel", "amount", "amount_net", "amount_final", "internal_taxes", "quantity",
    ),
    "articles": (
        "product_key", "product_name", "family", "line", "brand", "business_unit", "segment",
        "division", "supplier", "flavor", "uxb", "caliber",
    ),
    "routes": ("sales_force", "seller_name", "route_description"),
    "sellers": ("seller_key", "seller_name", "route_description", "sales_force"),
}
REQUIRED_FIELDS = {
    "sales": ("client_key", "amount"),
    "articles": ("product_key",),
    "routes": ("seller_name",),
    "sellers": (),
}

# Dimension columns an article master contributes to the fact.
ARTICLE_ATTRIBUTES = (
    "family", "line", "brand", "business_unit", "segment", "division", "supplier", "flavor", "uxb", "caliber",
)

STATUSES = ("Activo", "Dormido", "Reactivable", "Perdido")
